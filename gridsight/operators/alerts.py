"""Alert rules on application metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR, MINUTE, SECOND

# Metrics, operators and units of a rule.
METRICS = ["appFinalStatus", "appRuntime", "totalExecutorRuntime", "totalJVMGCtime", "maxTaskRuntime"]
UNIT_MS = {"ms": 1, "secs": SECOND, "mins": MINUTE, "hrs": HOUR, "boolean": 1}
ABOVE, EQUALS = "exceeds", "equals"


def threshold(value: Column, unit: Column) -> Column:
    """The value of a rule in milliseconds; a boolean is 1 or 0."""
    factors = F.create_map(*[F.lit(part) for name, factor in UNIT_MS.items() for part in (name, factor)])
    return value.cast("bigint") * F.try_element_at(factors, unit).cast("bigint")


def fires(measured: Column, operator: Column, limit: Column) -> Column:
    return F.when(operator == ABOVE, measured > limit).when(operator == EQUALS, measured == limit)


def alert_metrics(tasks: DataFrame, *context: Column) -> DataFrame:
    """The five metrics of each job, and of each value of the context, as rows; times in milliseconds.

    ``job_id`` is the platform's job, unique across applications. Formulas are
    ours: a job has succeeded (1) when no task failed; its run time is first
    launch to last finish.
    """
    totals = tasks.groupBy(*context, "job_id").agg(
        F.when(F.count_if(F.col("state") == "failed") == 0, 1).otherwise(0).cast("bigint").alias("appFinalStatus"),
        (F.max(F.col("launch_ms") + F.col("duration_ms")) - F.min("launch_ms")).alias("appRuntime"),
        F.sum("duration_ms").alias("totalExecutorRuntime"),
        F.sum("gc_ms").alias("totalJVMGCtime"),
        F.max("duration_ms").alias("maxTaskRuntime"),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).cast("bigint").alias("measured")) for name in METRICS])
    kept = [name for name in totals.columns if name not in METRICS]
    return totals.select(*kept, F.inline(rows))


def evaluate_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that fire.

    A rule belongs to a job and a metric, so this is an equi-join of one row
    per job and metric with the rules. Rules with an unknown operator or unit
    never fire.
    """
    limits = rules.withColumn("limit", threshold(F.col("value"), F.col("unit")))
    context = [name for name in metrics.columns if name not in ("job_id", "metric", "measured")]
    return (
        metrics.join(limits, ["job_id", "metric"])
        .filter(fires(F.col("measured"), F.col("operator"), F.col("limit")))
        .select(*context, "job_id", "alert_id", "metric", "operator", "measured", "limit")
    )
