"""Spark application queries."""

from pyspark.sql import functions as F

from ..functions.numbers import fraction_percent
from ..functions.times import moment
from ..operators import alerts, apps, series
from . import bindings as b
from .binding_sql import NOW, bytes_to_size, elapsed, interval_ms, interval_ms_decimal, mean, pick, readable_time
from .catalogue import query

HISTORY_NOW = "1004572800000"


@query("A1", "SELECT app_id, name, position, attempt_id, start_ms, end_ms, completed, duration_ms, spark_user FROM attempts", ["attempts"])
def app_attempts(spark, folder):
    return apps.app_attempts(b.history(spark, folder))


@query(
    "A2",
    "SELECT app_id, CASE WHEN arg_max(completed, position) THEN 'succeeded' ELSE 'running' END AS status FROM attempts GROUP BY app_id",
    ["attempts"],
)
def app_status(spark, folder):
    return apps.app_status(b.history(spark, folder))


@query(
    "A3 X11 X12",
    f"SELECT app_id, runtime_ms, {readable_time('runtime_ms')} AS runtime, runtime_ms // 86400000 AS days, runtime_ms // 3600000 % 24 AS "
    "hours, runtime_ms // 60000 % 60 AS minutes, runtime_ms // 1000 % 60 AS seconds, runtime_ms % 1000 AS milliseconds FROM (SELECT "
    "app_id, CASE WHEN arg_min(completed, position) THEN arg_min(end_ms - start_ms, position) ELSE greatest(max(end_ms), "
    f"{HISTORY_NOW}) - min(start_ms) END AS runtime_ms FROM attempts GROUP BY app_id)",
    ["attempts"],
)
def app_runtime(spark, folder):
    result = apps.app_runtime(b.history(spark, folder), F.lit(b.HISTORY_NOW_MS))
    return result.select("app_id", "runtime_ms", "runtime", "parts.*")


@query(
    "A4 X5",
    f"SELECT app_id, start_ms AS started_ms, ({interval_ms(f'({HISTORY_NOW} - start_ms)')}) || ' ago' AS started FROM attempts "
    "WHERE position = 0",
    ["attempts"],
)
def app_started(spark, folder):
    return apps.app_started(b.history(spark, folder), F.lit(b.HISTORY_NOW_MS))


@query(
    "A5 X3",
    f"SELECT *, {interval_ms_decimal('time_taken_ms')} AS time_taken FROM (SELECT app_id, max(launch_ms + duration_ms) - min(launch_ms) AS "
    f"time_taken_ms, {mean('sum(duration_ms)', 'count(*)')} AS avg_task_ms, max(duration_ms) AS max_task_ms, CAST(sum(duration_ms) AS "
    "BIGINT) AS executor_ms, CAST(sum(gc_ms) AS BIGINT) AS gc_ms FROM tasks GROUP BY app_id)",
    ["tasks"],
)
def attempt_metrics(spark, folder):
    return apps.attempt_metrics(b.tasks(spark, folder))


@query(
    "A6",
    f"SELECT app_id, job_id, stages, completed_stages, start_ms, end_ms, {readable_time('(end_ms - start_ms)')} AS runtime, CASE WHEN "
    "active > 0 THEN 'running' WHEN failed > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM (SELECT app_id, job_id, count(*) AS "
    "stages, count(*) FILTER (done) AS completed_stages, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(active) AS active, "
    "sum(failed) AS failed FROM (SELECT app_id, job_id, stage_id, bool_and(state = 'completed') AS done, min(launch_ms) AS start_ms, "
    "max(launch_ms + duration_ms) AS end_ms, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'failed') AS failed "
    "FROM tasks GROUP BY ALL) GROUP BY app_id, job_id)",
    ["tasks"],
)
def job_list(spark, folder):
    return apps.job_list(b.tasks(spark, folder))


_SUMS = [
    "input_records", "output_records", "shuffle_read_records", "shuffle_write_records", "input_bytes", "output_bytes",
    "shuffle_read_bytes", "shuffle_write_bytes",
]


@query(
    "A7 X7",
    f"SELECT *, {bytes_to_size('input_bytes')} AS input_size, {bytes_to_size('shuffle_write_bytes')} AS shuffle_write_size FROM (SELECT "
    "app_id, job_id, stage_id, count(*) AS tasks, count(*) FILTER (state = 'completed') AS completed, "
    + ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in _SUMS)
    + " FROM tasks GROUP BY app_id, job_id, stage_id)",
    ["tasks"],
)
def stage_list(spark, folder):
    return apps.stage_list(b.tasks(spark, folder))


def _measures(name: str) -> str:
    return (
        f"min({name}) AS {name}_min, {mean(f'sum({name})', f'count({name})')} AS {name}_mean, max({name}) AS {name}_max, "
        f"CAST(sum({name}) AS BIGINT) AS {name}_total"
    )


@query(
    "A8",
    "SELECT app_id, stage_id, " + ", ".join(_measures(name) for name in apps.STAGE_METRICS) + " FROM tasks GROUP BY app_id, stage_id",
    ["tasks"],
)
def stage_summary(spark, folder):
    return apps.stage_summary(b.tasks(spark, folder))


@query(
    "A9",
    " UNION ALL ".join(
        f"SELECT app_id, stage_id, '{name}' AS name, min({name}) AS min, {mean(f'sum({name})', 'count(*)')} AS mean, max({name}) AS max, "
        f"CAST(sum({name}) AS BIGINT) AS total FROM tasks GROUP BY app_id, stage_id"
        for name in apps.STAGE_METRICS
    ),
    ["tasks"],
)
def stage_metric_rows(spark, folder):
    return apps.stage_metric_rows(apps.stage_summary(b.tasks(spark, folder)))


@query(
    "A10",
    "SELECT app_id, stage_id, "
    + ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in apps.PHASES)
    + " FROM tasks GROUP BY app_id, stage_id",
    ["tasks"],
)
def task_timeline(spark, folder):
    return apps.task_timeline(b.tasks(spark, folder))


_WORK = ["task_ms", "input_bytes", "shuffle_read_bytes", "shuffle_write_bytes"]
_EXECUTOR = ["cores", "max_memory", "used_memory", "disk_used", "active_tasks", "failed_tasks", "completed_tasks", *_WORK]


@query(
    "A11",
    f"SELECT *, {mean('used_memory * 100', 'max_memory')} AS memory_percent FROM (SELECT app_id, executor_id, grouping(executor_id) = 1 AS is_total, "
    + ", ".join(f"CAST(coalesce(sum({name}), 0) AS BIGINT) AS {name}" for name in _EXECUTOR)
    + " FROM (SELECT DISTINCT s_suppkey % 6 AS app_id, s_suppkey % 9 AS executor_id, s_suppkey % 9 % 4 + 1 AS cores, (s_suppkey % 9 + 1) * 1000000 AS max_memory, "
    "(s_suppkey % 9 + 1) * 123456 AS used_memory, s_suppkey % 9 * 777 AS disk_used FROM supplier) FULL JOIN (SELECT app_id, executor_id, "
    "count(*) FILTER (state = 'active') AS active_tasks, count(*) FILTER (state = 'failed') AS failed_tasks, count(*) FILTER "
    "(state = 'completed') AS completed_tasks, sum(duration_ms) AS task_ms, sum(input_bytes) AS input_bytes, sum(shuffle_read_bytes) AS "
    "shuffle_read_bytes, sum(shuffle_write_bytes) AS shuffle_write_bytes FROM tasks GROUP BY ALL) USING (app_id, executor_id) "
    "GROUP BY GROUPING SETS ((app_id, executor_id), (app_id)))",
    ["tasks"],
)
def executor_table(spark, folder):
    return apps.executor_table(b.tasks(spark, folder), b.executors(spark, folder))


@query(
    "A12",
    "SELECT app_id, worker_id, grouping(worker_id) = 1 AS is_total, count(DISTINCT executor_id) AS executors, max(used) AS peak_used, "
    "CAST(sum(max_memory) AS BIGINT) AS allocated, CAST(sum(used) AS BIGINT) AS storage_used FROM (SELECT app_id, worker_id, "
    "executor_id, max(used) AS used, max(max_memory) AS max_memory FROM samples GROUP BY ALL) GROUP BY GROUPING SETS "
    "((app_id, worker_id), (app_id))",
    ["samples"],
)
def executors_overview(spark, folder):
    return series.executors_overview(b.samples(spark, folder))


@query(
    "A13",
    "SELECT app_id, worker_id, executor_id, CAST(hour AS DATE) AS day, string_agg(strftime(hour, '%Y-%m-%d %H:%M:%S') || '=' || used, ',' "
    "ORDER BY hour) AS points FROM (SELECT app_id, worker_id, executor_id, date_trunc('hour', ts) AS hour, max(used) AS used FROM samples "
    "GROUP BY ALL) GROUP BY ALL",
    ["samples"],
)
def worker_memory_series(spark, folder):
    points = F.transform(
        "points",
        lambda point: F.concat(F.date_format(point["hour"], "yyyy-MM-dd HH:mm:ss"), F.lit("="), point["used"].cast("string")),
    )
    return series.worker_memory_series(b.samples(spark, folder)).withColumn("points", F.array_join(points, ","))


@query(
    "A14",
    f"SELECT app_id, executor_id, max(max_memory) AS max_memory, {mean('sum(used)', 'count(used)')} AS avg_used, "
    f"{mean('sum(executor_cpu)', 'count(executor_cpu)')} AS avg_cpu FROM samples GROUP BY app_id, executor_id",
    ["samples"],
)
def executor_summary(spark, folder):
    return series.executor_summary(b.samples(spark, folder))


_IN_HEAP = "CASE WHEN region IN ('eden', 'old', 'survivor') THEN used ELSE 0 END"
_OFF_HEAP = "CASE WHEN region IN ('metaspace', 'code_cache') THEN used ELSE 0 END"


@query(
    "A15 X10",
    f"SELECT app_id, executor_id, ts, {_IN_HEAP} AS heap_used, max_memory AS heap_max, CAST(round(({_IN_HEAP} / max_memory) * 100) AS "
    f"BIGINT) || '%' AS heap_text, CAST(round({_IN_HEAP} * 100 / max_memory) AS BIGINT) AS heap_percent, CASE WHEN region = 'eden' THEN "
    f"used ELSE 0 END AS eden_used, {_OFF_HEAP} AS non_heap_used, CASE WHEN region = 'code_cache' THEN used ELSE 0 END AS "
    "code_cache_used, executor_cpu AS process, system_cpu AS system FROM samples",
    ["samples"],
)
def executor_detail(spark, folder):
    return series.executor_detail(b.samples(spark, folder)).select(
        "app_id",
        "executor_id",
        "ts",
        F.col("heap.used").alias("heap_used"),
        F.col("heap.max").alias("heap_max"),
        fraction_percent(F.col("heap.fraction")).alias("heap_text"),
        F.col("heap.percent").alias("heap_percent"),
        F.col("heap.eden_used").alias("eden_used"),
        F.col("non_heap.used").alias("non_heap_used"),
        F.col("non_heap.code_cache_used").alias("code_cache_used"),
        "cpu.process",
        "cpu.system",
    )


def _per_executor(measures: dict[str, str], where: str = "") -> str:
    inner = ", ".join(f"max({value}) AS {name}" for name, value in measures.items())
    outer = ", ".join(f"CAST(coalesce(sum({name}), 0) AS BIGINT) AS {name}" for name in measures)
    buckets = (
        f"(SELECT app_id, bucket, {outer} FROM (SELECT app_id, executor_id, date_trunc('hour', ts) AS bucket, {inner} FROM samples "
        f"{where} GROUP BY ALL) GROUP BY app_id, bucket)"
    )
    return " UNION ALL ".join(f"SELECT app_id, bucket, '{name}' AS series, {name} AS value FROM {buckets}" for name in measures)


def _region(name: str) -> str:
    return f"CASE WHEN region = '{name}' THEN used END"


@query(
    "A16",
    _per_executor(
        {"available_cores": "cores", "active_tasks": "tasks"},
        "WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00'",
    ),
    ["samples"],
)
def cores_vs_tasks_series(spark, folder):
    return series.cores_vs_tasks_series(
        b.samples(spark, folder), "1 hour", moment("2024-01-03 00:00:00"), moment("2024-01-28 00:00:00")
    )


@query(
    "A17",
    " UNION ALL ".join(
        f"SELECT app_id, date_trunc('hour', ts) AS bucket, '{name}' AS series, {mean(f'sum({name})', f'count({name})')} AS value "
        "FROM samples GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2")
        for name in ("executor_cpu", "system_cpu")
    ),
    ["samples"],
)
def cpu_series(spark, folder):
    return series.cpu_series(b.samples(spark, folder))


@query(
    "A18",
    _per_executor(
        {
            "heap": "CASE WHEN region IN ('eden', 'old', 'survivor') THEN used END",
            "off_heap": "CASE WHEN region IN ('metaspace', 'code_cache') THEN used END",
            "cluster_max": "max_memory",
            "cluster_usage": "used",
        }
    ),
    ["samples"],
)
def memory_series(spark, folder):
    return series.memory_series(b.samples(spark, folder))


@query("A19", _per_executor({name: _region(name) for name in series.HEAP_REGIONS}), ["samples"])
def heap_region_series(spark, folder):
    return series.heap_region_series(b.samples(spark, folder))


@query("A20", _per_executor({name: _region(name) for name in series.OFFHEAP_REGIONS}), ["samples"])
def offheap_region_series(spark, folder):
    return series.offheap_region_series(b.samples(spark, folder))


@query(
    "A16 A18",
    "SELECT app_id, series, min(bucket) AS start_ts, max(bucket) AS end_ts, count(*) AS points FROM (SELECT DISTINCT app_id, "
    "date_trunc('hour', ts) AS bucket FROM samples), (VALUES ('available_cores'), ('active_tasks')) v(series) GROUP BY ALL",
    ["samples"],
)
def series_range(spark, folder):
    return series.series_range(series.cores_vs_tasks_series(b.samples(spark, folder)))


_STATES = ", ".join(f"count(*) FILTER (state = '{state}') AS {state}_tasks" for state in apps.STATES)
_COUNTED = ", ".join(f"coalesce({state}_tasks, 0) AS {state}_tasks" for state in apps.STATES)


@query(
    "A21",
    f"SELECT app_id, {_COUNTED}, cpu_peak, cpu_avg, memory_peak, memory_avg FROM (SELECT app_id, {_STATES} FROM tasks GROUP BY app_id) "
    "FULL JOIN (SELECT app_id, max(executor_cpu) AS cpu_peak, "
    f"{mean('sum(executor_cpu)', 'count(executor_cpu)')} AS cpu_avg, max(used) AS memory_peak, {mean('sum(used)', 'count(used)')} AS "
    "memory_avg FROM samples GROUP BY app_id) USING (app_id)",
    ["tasks", "samples"],
)
def app_overview(spark, folder):
    return apps.app_overview(b.samples(spark, folder), b.tasks(spark, folder))


@query(
    "A22",
    "SELECT app_id, count(DISTINCT executor_id) AS executors, count(DISTINCT job_id) AS jobs, count(DISTINCT stage_id) AS stages, "
    "count(*) AS tasks FROM tasks GROUP BY app_id",
    ["tasks"],
)
def runtime_counters(spark, folder):
    return apps.runtime_counters(b.tasks(spark, folder))


@query(
    "A23",
    "SELECT r_regionkey::BIGINT AS run_id, r_name AS name, CASE r_regionkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE "
    f"'unknown' END AS status, runtime_ms, {readable_time('runtime_ms')} AS runtime, avg_memory, avg_cpu, jobs, stages, slowest_job, "
    f"{readable_time('slow_job_ms')} AS slowest_job_runtime, slowest_stage, {readable_time('slow_stage_ms')} AS slowest_stage_runtime, "
    "executors, used_memory, max_memory, total_tasks, input_bytes FROM region LEFT JOIN (SELECT app_id, count(DISTINCT job_id) AS jobs, "
    "count(DISTINCT stage_id) AS stages, max(launch_ms + duration_ms) - min(launch_ms) AS runtime_ms, count(*) AS total_tasks, "
    "CAST(sum(input_bytes) AS BIGINT) AS input_bytes FROM tasks GROUP BY app_id) t ON t.app_id = r_regionkey LEFT JOIN (SELECT app_id, "
    "job_id AS slowest_job, ms AS slow_job_ms FROM (SELECT app_id, job_id, max(launch_ms + duration_ms) - min(launch_ms) AS ms FROM tasks "
    "GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY ms DESC, job_id) = 1) j ON j.app_id = r_regionkey LEFT JOIN "
    "(SELECT app_id, stage_id AS slowest_stage, ms AS slow_stage_ms FROM (SELECT app_id, stage_id, max(launch_ms + duration_ms) - "
    "min(launch_ms) AS ms FROM tasks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY ms DESC, stage_id) = 1) s ON "
    "s.app_id = r_regionkey LEFT JOIN (SELECT app_id, count(*) AS executors, CAST(sum(used) AS BIGINT) AS used_memory, CAST(sum(lim) AS "
    "BIGINT) AS max_memory FROM (SELECT app_id, executor_id, max(used) AS used, max(max_memory) AS lim FROM samples GROUP BY ALL) GROUP BY "
    f"app_id) e ON e.app_id = r_regionkey LEFT JOIN (SELECT app_id, {mean('sum(used)', 'count(used)')} AS avg_memory, "
    f"{mean('sum(executor_cpu)', 'count(executor_cpu)')} AS avg_cpu FROM samples GROUP BY app_id) a ON a.app_id = r_regionkey",
    ["tasks", "samples"],
)
def compare_runs(spark, folder):
    return apps.compare_runs(b.runs(spark, folder), b.tasks(spark, folder), b.samples(spark, folder))


@query(
    "A24",
    "SELECT app_id, stage_id, title, description, CAST(severity AS INTEGER) AS severity FROM (SELECT app_id, stage_id, 'Task skew' AS title, "
    "'longest task ' || max(duration_ms) || ' ms' AS description, 2 AS severity FROM tasks GROUP BY ALL HAVING max(duration_ms) * count(*) * "
    "100 > sum(duration_ms) * 196 UNION ALL SELECT app_id, stage_id, 'GC pressure', 'collection took ' || sum(gc_ms) || ' ms', 1 FROM tasks "
    "GROUP BY app_id, stage_id HAVING sum(gc_ms) * 100 > sum(duration_ms) UNION ALL SELECT app_id, stage_id, 'Failed tasks', count(*) FILTER "
    "(state = 'failed') || ' of ' || count(*) || ' tasks failed', 3 FROM tasks GROUP BY app_id, stage_id HAVING count(*) FILTER "
    "(state = 'failed') * 100 > count(*) * 33)".replace("FROM tasks GROUP BY ALL HAVING", "FROM tasks GROUP BY app_id, stage_id HAVING"),
    ["tasks"],
)
def runtime_observations(spark, folder):
    return apps.runtime_observations(b.tasks(spark, folder), 196, 1, 33)


_RULES = (
    "(SELECT CAST(n_nationkey AS BIGINT) AS alert_id, CAST(n_nationkey % 10 AS BIGINT) AS job_id, "
    f"{pick('n_nationkey', b.ALERT_METRICS)} AS metric, CASE WHEN n_nationkey % 5 = 0 THEN 'equals' ELSE 'exceeds' END AS operator, "
    "CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE CAST(n_nationkey * 7 AS BIGINT) * list_extract([1, 1000, 60000, 3600000], "
    "CAST(n_nationkey % 4 AS INTEGER) + 1) END AS lim FROM nation)"
)
_METRICS = {
    "appFinalStatus": "CASE WHEN count(*) FILTER (state = 'failed') = 0 THEN 1 ELSE 0 END",
    "appRuntime": "max(launch_ms + duration_ms) - min(launch_ms)",
    "totalExecutorRuntime": "sum(duration_ms)",
    "totalJVMGCtime": "sum(gc_ms)",
    "maxTaskRuntime": "max(duration_ms)",
}
_FIRES = "CASE WHEN operator = 'exceeds' THEN measured > lim ELSE measured = lim END"


def _metric_rows(source: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, job_id, '{name}' AS metric, CAST({value} AS BIGINT) AS measured FROM {source} GROUP BY ALL"
        for name, value in _METRICS.items()
    )


@query(
    "A25",
    f"SELECT job_id, alert_id, metric, operator, measured, CAST(lim AS BIGINT) AS \"limit\" FROM ({_metric_rows('tasks', '1 AS one')}) JOIN "
    f"{_RULES} USING (job_id, metric) WHERE {_FIRES}",
    ["tasks"],
)
def evaluate_alerts(spark, folder):
    return alerts.evaluate_alerts(alerts.alert_metrics(b.tasks(spark, folder)), b.alert_rules(spark, folder))


@query(
    "A28 X3 X5",
    "SELECT deployment_id, row_number() OVER (PARTITION BY deployment_id ORDER BY started DESC, run_id DESC) AS position, "
    f"run_id, status, trigger, started, ({interval_ms(elapsed('started', NOW))}) || ' ago' AS triggered, "
    f"{interval_ms_decimal(elapsed('started', f'coalesce(ended, {NOW})'))} AS runtime FROM (SELECT o_custkey AS deployment_id, o_orderkey AS "
    f"run_id, {pick('o_orderkey', ['succeeded', 'failed', 'running', 'unknown'])} AS status, "
    f"{pick('o_orderkey', ['manually', 'by agent', 'manually'])} AS trigger, o_orderdate AS started, CASE WHEN o_orderstatus <> 'P' THEN "
    "o_orderdate + to_seconds(o_orderkey % 200000 + 1) END AS ended FROM orders)",
)
def deployment_history(spark, folder):
    return apps.deployment_history(b.deployment_runs(spark, folder), b.now())
