"""Restarts of monitored processes, and when the monitor gives up.

A check that finds a process down asks for a restart, which happens after the
retry interval, by itself: it needs no later check of that process. When a
check finds a process down and the restarts so far have reached the limit, the
monitor gives up and later checks count no more. Restarts never reset.

The clock is the newest check of any process. The restarts of a process by time
``t`` are its down checks up to ``t - interval``, so a restart is counted once
the clock, or the time of giving up, has passed its due time. With a limit of
``m`` the monitor gives up at the first down check at least an interval after
the ``m``-th. No sequential pass and no timer per process is needed.

``checks`` has cluster_id, process, ts, seq and alive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_reduced

KEY = ["cluster_id", "process"]
BUDGET_SCHEMA = (
    "cluster_id bigint, process string, status string, last_ts timestamp_ntz, restarts_used bigint, "
    "given_up_at timestamp_ntz"
)
KNOWN_SCHEMA = (
    "cluster_id bigint, process string, status string, last_ts timestamp_ntz, downs bigint, exhausted_at timestamp_ntz, "
    "given_up_at timestamp_ntz"
)
DOWN_SCHEMA = "cluster_id bigint, process string, ts timestamp_ntz, checks bigint"


def _later(ts: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), ts)


def down_checks(checks: DataFrame) -> DataFrame:
    """Times at which a process was found down, with the number of checks that did; those of one time are combined before they are moved."""
    return checks.filter(~F.col("alive")).groupBy(*KEY, "ts").agg(F.count(F.lit(1)).alias("checks"))


def known_processes(checks: DataFrame, downs: DataFrame, before: DataFrame, max_retry: int, retry_s: int) -> DataFrame:
    """Each checked process with its newest status, its down checks, when its restarts reach the limit, and when the monitor gave up.

    ``downs`` are the down checks among ``checks``, ``before`` what was known of these processes.
    """
    alive = F.when(F.col("alive"), F.lit("running")).otherwise(F.lit("stopped"))
    newest = checks.groupBy(*KEY).agg(
        F.max("ts").alias("last_ts"), F.max_by(alive, F.struct("ts", "seq")).alias("status"), F.count_if(~F.col("alive")).alias("more")
    )
    had = before.select(*KEY, "downs", "exhausted_at", "given_up_at")
    known = join_reduced(newest, had, KEY, "left").withColumn("downs", F.coalesce("downs", F.lit(0)))
    if max_retry <= 0:
        armed = known.withColumn("reached_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    else:
        # each time counts at least one check, so the first max_retry times are enough
        in_order = Window.partitionBy(*KEY).orderBy("ts")
        first = downs.withColumn("nth", F.row_number().over(in_order)).filter(F.col("nth") <= max_retry)
        first = first.withColumn("so_far", F.sum("checks").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        last = join_reduced(first, known.select(*KEY, "downs"), KEY).filter(F.col("so_far") + F.col("downs") >= max_retry)
        last = last.groupBy(*KEY).agg(_later(F.min("ts"), retry_s).alias("reached_at"))
        armed = join_reduced(known, last, KEY, "left")
        armed = armed.withColumn("reached_at", F.coalesce("exhausted_at", "reached_at"))
    limits = armed.filter(F.col("given_up_at").isNull()).select(*KEY, "reached_at")
    late = join_reduced(downs, limits, KEY).filter(F.col("ts") >= F.col("reached_at")).groupBy(*KEY).agg(F.min("ts").alias("gives_up_at"))
    done = join_reduced(armed, late, KEY, "left")
    return done.select(
        *KEY, "status", "last_ts", (F.col("downs") + F.col("more")).alias("downs"), F.col("reached_at").alias("exhausted_at"),
        F.coalesce("given_up_at", "gives_up_at").alias("given_up_at"),
    )


def budget(known: DataFrame, downs: DataFrame, clock: Column, retry_s: int) -> DataFrame:
    """Status, restarts used and time of giving up of each process, at a clock."""
    due = _later(F.least("given_up_at", clock), -retry_s)
    happened = (
        join_reduced(downs, known.select(*KEY, due.alias("due")), KEY)
        .filter(F.col("ts") <= F.col("due"))
        .groupBy(*KEY)
        .agg(F.sum("checks").alias("happened"))
    )
    over = F.col("given_up_at").isNotNull()
    return join_reduced(known, happened, KEY, "left").select(
        *KEY,
        F.when(over, F.lit("stopped")).otherwise(F.col("status")).alias("status"),
        F.when(over, F.col("given_up_at")).otherwise(F.col("last_ts")).alias("last_ts"),
        F.coalesce("happened", F.lit(0).cast("bigint")).alias("restarts_used"),
        "given_up_at",
    )


def settled(downs: DataFrame, known: DataFrame, clock: Column, retry_s: int) -> DataFrame:
    """Down checks with those whose restart has happened for good combined to one row per process, and those that never lead to one gone.

    ``downs`` may carry the batch that wrote them, of which the newest stays.
    """
    joined = join_reduced(downs, known.select(*KEY, "given_up_at"), KEY, "left")
    happened = F.col("ts") <= _later(F.coalesce("given_up_at", clock), -retry_s)
    rows = joined.filter(happened | F.col("given_up_at").isNull()).withColumn("apart", F.when(~happened, F.col("ts")))
    others = [F.max(name).alias(name) for name in downs.columns if name not in (*KEY, "checks")]
    return rows.groupBy(*KEY, "apart").agg(F.sum("checks").alias("checks"), *others).select(*downs.columns)


def restart_budget(checks: DataFrame, max_retry: int, retry_s: int) -> DataFrame:
    """T6 over all checks at once."""
    downs = down_checks(checks)
    nothing = checks.sparkSession.createDataFrame([], KNOWN_SCHEMA)
    known = known_processes(checks, downs, nothing, max_retry, retry_s)
    return budget(known, downs, checks.agg(F.max("ts")).scalar(), retry_s)
