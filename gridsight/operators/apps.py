"""Spark applications: history, jobs, stages, executors and runs.

``history`` has app_id, name and ``attempts``, an array of (attempt_id, start_ms,
end_ms, completed, duration_ms, spark_user) as the history server lists it;
an open attempt ends at -1.

``tasks`` has one row per task: app_id, job_id, stage_id, executor_id,
launch_ms, duration_ms, gc_ms, state, sizes, records and phases. Where a result
has no formula of its own, the docstring gives the one chosen here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise
from ..functions.numbers import int_mean
from ..functions.sizes import bytes_to_size
from ..functions.times import (
    format_interval_ms,
    format_interval_ms_decimal,
    readable_time,
    split_ms,
    time_elapsed,
    time_elapsed_fraction,
)
from .spans import with_position

STAGE_METRICS = [
    "duration_ms", "gc_ms", "input_records", "input_bytes", "output_records", "output_bytes",
    "shuffle_read_records", "shuffle_read_bytes", "shuffle_write_bytes", "shuffle_write_records",
]
PHASES = [
    "scheduler_delay", "compute", "shuffle_read_time", "shuffle_write_time", "getting_result", "deserialise", "serialise",
]
STATES = ["active", "completed", "failed", "skipped"]


def app_attempts(history: DataFrame) -> DataFrame:
    """A1: one row per attempt, in listed order."""
    return history.select("app_id", "name", F.posexplode("attempts").alias("position", "attempt")).select(
        "app_id", "name", F.col("position").cast("bigint").alias("position"), "attempt.*"
    )


def app_status(history: DataFrame) -> DataFrame:
    """A2: the state of the last listed attempt; null without attempts."""
    last = F.try_element_at("attempts", F.lit(-1))
    state = F.when(last["completed"], F.lit("succeeded")).when(last.isNotNull(), F.lit("running"))
    return history.select("app_id", state.alias("status"))


def app_runtime(history: DataFrame, now_ms: Column) -> DataFrame:
    """A3: run time of each application.

    If the first listed attempt is complete, its own span counts. Otherwise the
    span runs from the earliest start to the end found by reading the attempts
    in order: an open attempt moves the end to now, a later end moves it on.
    """
    first = F.try_element_at("attempts", F.lit(1))
    end = F.aggregate(
        "attempts",
        F.lit(0).cast("bigint"),
        lambda latest, attempt: F.when(attempt["end_ms"] == -1, now_ms).otherwise(
            F.greatest(latest, attempt["end_ms"])
        ),
    )
    start = F.array_min(F.transform("attempts", lambda attempt: attempt["start_ms"]))
    span = F.when(first["completed"], first["end_ms"] - first["start_ms"]).when(first.isNotNull(), end - start)
    timed = history.select("app_id", span.alias("runtime_ms"))
    return timed.select(
        "app_id", "runtime_ms", readable_time(F.col("runtime_ms")).alias("runtime"), split_ms(F.col("runtime_ms")).alias("parts")
    )


def app_started(history: DataFrame, now_ms: Column) -> DataFrame:
    """A4: start of the first listed attempt, and how long ago that was."""
    start = F.try_element_at("attempts", F.lit(1))["start_ms"]
    return history.select(
        "app_id",
        start.alias("started_ms"),
        F.concat(format_interval_ms(now_ms - start), F.lit(" ago")).alias("started"),
    )


def _end() -> Column:
    return F.max(F.col("launch_ms") + F.col("duration_ms"))


def _tasks() -> Column:
    return F.count(F.lit(1))


def _in_state(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def attempt_metrics(tasks: DataFrame) -> DataFrame:
    """A5: time taken, mean and longest task, executor and GC time of each application.

    Time taken runs from the first launch to the last finish; the mean is
    rounded half up; executor time is the sum of task durations.
    """
    return (
        tasks.groupBy("app_id")
        .agg(
            (_end() - F.min("launch_ms")).alias("time_taken_ms"),
            int_mean(F.sum("duration_ms"), _tasks()).alias("avg_task_ms"),
            F.max("duration_ms").alias("max_task_ms"),
            F.sum("duration_ms").alias("executor_ms"),
            F.sum("gc_ms").alias("gc_ms"),
        )
        .withColumn("time_taken", format_interval_ms_decimal(F.col("time_taken_ms")))
    )


def _stage_totals(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("app_id", "job_id", "stage_id").agg(
        _tasks().alias("tasks"),
        *[_in_state(state).alias(state) for state in STATES],
        F.min("launch_ms").alias("start_ms"),
        _end().alias("end_ms"),
    )


def job_list(tasks: DataFrame) -> DataFrame:
    """Stages, times and state of each job.

    A stage is complete when all its tasks are. A job is running while a task
    is active, else failed if a task failed, else succeeded.
    """
    jobs = (
        _stage_totals(tasks)
        .groupBy("app_id", "job_id")
        .agg(
            _tasks().alias("stages"),
            F.count_if(F.col("completed") == F.col("tasks")).alias("completed_stages"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.sum("active").alias("active"),
            F.sum("failed").alias("failed"),
        )
    )
    status = (
        F.when(F.col("active") > 0, F.lit("running")).when(F.col("failed") > 0, F.lit("failed")).otherwise(F.lit("succeeded"))
    )
    return jobs.select(
        "app_id", "job_id", "stages", "completed_stages", "start_ms", "end_ms",
        readable_time(F.col("end_ms") - F.col("start_ms")).alias("runtime"),
        status.alias("status"),
    )


def stage_list(tasks: DataFrame) -> DataFrame:
    """Tasks, records and bytes of each stage."""
    sums = [
        "input_records", "output_records", "shuffle_read_records", "shuffle_write_records",
        "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    ]
    return (
        tasks.groupBy("app_id", "job_id", "stage_id")
        .agg(_tasks().alias("tasks"), _in_state("completed").alias("completed"), *[F.sum(name).alias(name) for name in sums])
        .withColumn("input_size", bytes_to_size(F.col("input_bytes")))
        .withColumn("shuffle_write_size", bytes_to_size(F.col("shuffle_write_bytes")))
    )


def stage_summary(tasks: DataFrame) -> DataFrame:
    """Least, mean (half up), greatest and total of ten task metrics per stage of an application, in one pass."""
    measures = []
    for name in STAGE_METRICS:
        measures += [
            F.min(name).alias(f"{name}_min"),
            int_mean(F.sum(name), F.count(name)).alias(f"{name}_mean"),
            F.max(name).alias(f"{name}_max"),
            F.sum(name).alias(f"{name}_total"),
        ]
    return tasks.groupBy("app_id", "stage_id").agg(*measures)


def stage_metric_rows(summary: DataFrame) -> DataFrame:
    """The summary as one row per stage and metric."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                *[F.col(f"{name}_{part}").cast("bigint").alias(part) for part in ("min", "mean", "max", "total")],
            )
            for name in STAGE_METRICS
        ]
    )
    return summary.select("app_id", "stage_id", F.inline(rows))


def task_timeline(tasks: DataFrame) -> DataFrame:
    """A10: total time of each task phase per stage of an application."""
    return tasks.groupBy("app_id", "stage_id").agg(*[F.sum(name).alias(name) for name in PHASES])


def executor_table(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Work and memory of each executor, and a row with the totals of each application.

    Tasks are reduced per executor before the join, so the grouping sees one row
    per executor; one known from either side alone counts too. Memory used is a
    whole percent of the maximum.
    """
    app, executor = F.col("app_id"), F.col("executor_id")
    work = tasks.groupBy(app, executor).agg(
        _in_state("active").alias("active_tasks"),
        _in_state("failed").alias("failed_tasks"),
        _in_state("completed").alias("completed_tasks"),
        F.sum("duration_ms").alias("task_ms"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("shuffle_read_bytes").alias("shuffle_read_bytes"),
        F.sum("shuffle_write_bytes").alias("shuffle_write_bytes"),
    )
    sums = [
        "cores", "max_memory", "used_memory", "disk_used", "active_tasks", "failed_tasks", "completed_tasks", "task_ms",
        "input_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    ]
    joined = executors.join(work, ["app_id", "executor_id"], "full")
    total = joined.groupingSets([[app, executor], [app]], app, executor).agg(
        F.grouping("executor_id").cast("boolean").alias("is_total"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in sums],
    )
    return total.withColumn("memory_percent", int_mean(F.col("used_memory") * 100, F.col("max_memory")))


def runtime_counters(tasks: DataFrame, approximate: bool = False) -> DataFrame:
    """Executors, jobs, stages and tasks of each application.

    Tasks are first counted per executor and stage, so the distinct counts run
    over that small table. ``approximate`` counts with sketches instead, for
    identifiers too many to hold.
    """
    if approximate:
        return tasks.groupBy("app_id").agg(
            *[F.approx_count_distinct(f"{name}_id").alias(f"{name}s") for name in ("executor", "job", "stage")],
            _tasks().alias("tasks"),
        )
    seen = tasks.groupBy("app_id", "executor_id", "job_id", "stage_id").agg(_tasks().alias("tasks"))
    return seen.groupBy("app_id").agg(
        *[F.count_distinct(f"{name}_id").alias(f"{name}s") for name in ("executor", "job", "stage")],
        F.sum("tasks").alias("tasks"),
    )


def app_overview(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """CPU and memory peaks and means, and tasks by state, of each application.

    CPU is the executor percentage of the samples that carry one; means are
    rounded half up.
    """
    load = samples.groupBy("app_id").agg(
        F.max("executor_cpu").alias("cpu_peak"),
        int_mean(F.sum("executor_cpu"), F.count("executor_cpu")).alias("cpu_avg"),
        F.max("used").alias("memory_peak"),
        int_mean(F.sum("used"), F.count("used")).alias("memory_avg"),
    )
    states = tasks.groupBy("app_id").agg(*[_in_state(state).alias(f"{state}_tasks") for state in STATES])
    counts = [F.coalesce(f"{state}_tasks", F.lit(0)).alias(f"{state}_tasks") for state in STATES]
    joined = states.join(load, "app_id", "full")  # an application may have samples and no task yet
    return joined.select("app_id", *counts, *[name for name in load.columns if name != "app_id"])


def compare_runs(runs: DataFrame, tasks: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per run with its averages, counters, slowest job and stage, and executor totals.

    The slowest is the longest from first launch to last finish, the lower id
    on a tie. Stages are reduced to jobs and jobs to runs before any join.
    """
    stages = tasks.groupBy("app_id", "job_id", "stage_id").agg(
        _tasks().alias("tasks"),
        F.min("launch_ms").alias("start_ms"),
        _end().alias("end_ms"),
        F.sum("input_bytes").alias("input_bytes"),
    )
    span = F.col("end_ms") - F.col("start_ms")
    jobs = stages.groupBy("app_id", "job_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        _tasks().alias("stages"),
        F.max(F.struct(span.alias("ms"), (-F.col("stage_id")).alias("neg"))).alias("slow_stage"),
        F.sum("tasks").alias("tasks"),
        F.sum("input_bytes").alias("input_bytes"),
    )
    per_run = jobs.groupBy("app_id").agg(
        _tasks().alias("jobs"),
        F.sum("stages").alias("stages"),
        F.max(F.struct(span.alias("ms"), (-F.col("job_id")).alias("neg"))).alias("slow_job"),
        F.max("slow_stage").alias("slow_stage"),
        F.sum("tasks").alias("total_tasks"),
        F.sum("input_bytes").alias("input_bytes"),
        (F.max("end_ms") - F.min("start_ms")).alias("runtime_ms"),
    )
    per_executor = samples.groupBy("app_id", "executor_id").agg(
        F.max("used").alias("used"), F.max("max_memory").alias("max_memory"), F.sum("used").alias("used_sum"),
        F.count("used").alias("used_count"), F.sum("executor_cpu").alias("cpu_sum"), F.count("executor_cpu").alias("cpu_count"),
    )
    load = per_executor.groupBy("app_id").agg(
        _tasks().alias("executors"),
        F.sum("used").alias("used_memory"),
        F.sum("max_memory").alias("max_memory"),
        int_mean(F.sum("used_sum"), F.sum("used_count")).alias("avg_memory"),
        int_mean(F.sum("cpu_sum"), F.sum("cpu_count")).alias("avg_cpu"),
    )
    return (
        runs.join(per_run, runs["run_id"] == per_run["app_id"], "left")
        .drop("app_id")
        .join(load, F.col("run_id") == load["app_id"], "left")
        .select(
            "run_id", "name", normalise(F.col("status"), "run_status").alias("status"), "runtime_ms",
            readable_time(F.col("runtime_ms")).alias("runtime"), "avg_memory", "avg_cpu", "jobs", "stages",
            (-F.col("slow_job.neg")).alias("slowest_job"), readable_time(F.col("slow_job.ms")).alias("slowest_job_runtime"),
            (-F.col("slow_stage.neg")).alias("slowest_stage"),
            readable_time(F.col("slow_stage.ms")).alias("slowest_stage_runtime"),
            "executors", "used_memory", "max_memory", "total_tasks", "input_bytes",
        )
    )


def runtime_observations(
    tasks: DataFrame, skew_percent: int = 300, gc_percent: int = 10, failed_percent: int = 0
) -> DataFrame:
    """Findings about each stage, with a severity of 1 to 3.

    Rules are ours: the longest task exceeds ``skew_percent`` of the mean (2);
    GC exceeds ``gc_percent`` of the task time (1); failed tasks exceed
    ``failed_percent`` of all (3).
    """
    stages = tasks.groupBy("app_id", "stage_id").agg(
        _tasks().alias("tasks"),
        F.max("duration_ms").alias("longest"),
        F.sum("duration_ms").alias("total"),
        F.sum("gc_ms").alias("gc"),
        _in_state("failed").alias("failed"),
    )
    number = lambda name: F.col(name).cast("string")
    rules = [
        (
            "Task skew",
            F.col("longest") * F.col("tasks") * 100 > F.col("total") * skew_percent,
            F.concat(F.lit("longest task "), number("longest"), F.lit(" ms")),
            2,
        ),
        (
            "GC pressure",
            F.col("gc") * 100 > F.col("total") * gc_percent,
            F.concat(F.lit("collection took "), number("gc"), F.lit(" ms")),
            1,
        ),
        (
            "Failed tasks",
            F.col("failed") * 100 > F.col("tasks") * failed_percent,
            F.concat(number("failed"), F.lit(" of "), number("tasks"), F.lit(" tasks failed")),
            3,
        ),
    ]
    findings = F.array(
        *[
            F.when(
                test,
                F.struct(F.lit(title).alias("title"), text.alias("description"), F.lit(severity).alias("severity")),
            )
            for title, test, text, severity in rules
        ]
    )
    return stages.select("app_id", "stage_id", F.inline(F.filter(findings, lambda finding: finding.isNotNull())))


def deployment_history(runs: DataFrame, now: Column, span_s: int = 7 * 86400) -> DataFrame:
    """Runs of each deployment, one row per run; ``position`` counts from the newest.

    An open run lasts until now. Runs are counted per deployment and span of
    time first and ordered within a span only, so a deployment with very many
    runs spreads over several tasks. Runs that started together go by id from
    the largest down, a run without a start comes last.
    """
    placed = with_position(runs, ["deployment_id"], "started", ["run_id"], "position", span_s)
    return placed.select(
        "deployment_id",
        "position",
        "run_id",
        normalise(F.col("status"), "run_status").alias("status"),
        normalise(F.col("trigger"), "trigger").alias("trigger"),
        "started",
        F.concat(time_elapsed("started", now), F.lit(" ago")).alias("triggered"),
        time_elapsed_fraction("started", F.col("ended"), now).alias("runtime"),
    )


def yarn_overview(nodes: DataFrame) -> DataFrame:
    """Used and available memory and cores of each YARN node, and the totals of each cluster."""
    sums = ["used_memory_mb", "available_memory_mb", "used_cores", "available_cores"]
    grouped = nodes.groupingSets(
        [[F.col("cluster_id")], [F.col("cluster_id"), F.col("node_id")]], F.col("cluster_id"), F.col("node_id")
    )
    return grouped.agg(
        F.grouping("node_id").cast("boolean").alias("is_total"), *[F.sum(name).alias(name) for name in sums]
    )


def yarn_applications(metrics: DataFrame) -> DataFrame:
    """Applications of each YARN cluster by state."""
    return metrics.select("cluster_id", "apps_completed", "apps_running", "apps_pending", "apps_killed")


def master_overview(masters: DataFrame, workers: DataFrame) -> DataFrame:
    """Alive and standby masters, alive workers and cores of each cluster.

    ``masters`` and ``workers`` carry cluster_id beside the columns of
    ``master_summary`` and ``worker_rows``.
    """
    lead = masters.groupBy("cluster_id").agg(
        F.count_if(F.col("status") == "ALIVE").alias("alive_masters"),
        F.count_if(F.col("status") != "ALIVE").alias("standby_masters"),
        F.sum(F.when(F.col("status") == "ALIVE", F.col("cores_used")).otherwise(0)).alias("cores_used"),
        F.sum(F.when(F.col("status") == "ALIVE", F.col("cores_total")).otherwise(0)).alias("cores_total"),
    )
    alive = workers.groupBy("cluster_id").agg(F.count_if(F.col("status") == "ALIVE").alias("alive_workers"))
    return lead.join(alive, "cluster_id", "left").withColumn(
        "alive_workers", F.coalesce("alive_workers", F.lit(0).cast("bigint"))
    )
