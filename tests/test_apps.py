from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridsight.operators import alerts, apps, query, series

ATTEMPTS = "array<struct<attempt_id:string,start_ms:bigint,end_ms:bigint,completed:boolean,duration_ms:bigint,spark_user:string>>"


@pytest.fixture
def history(spark):
    def attempt(number, start, end):
        return (str(number), start, end, end != -1, 0, "u")

    return spark.createDataFrame(
        [
            (1, "done", [attempt(2, 5000, 6500), attempt(1, 1000, 2000)]),
            (2, "open", [attempt(2, 5000, -1), attempt(1, 1000, 2000)]),
            (3, "late", [attempt(1, 1000, -1), attempt(2, 2000, 900000)]),
            (4, "none", []),
        ],
        f"app_id bigint, name string, attempts {ATTEMPTS}",
    )


def test_history(history, rows):
    assert rows(apps.app_status(history)) == [(1, "succeeded"), (2, "succeeded"), (3, "succeeded"), (4, None)]
    runtime = apps.app_runtime(history, F.lit(61000).cast("bigint"))
    assert rows(runtime, "app_id", "runtime_ms", "runtime") == [
        (1, 1500, "1.5 secs"), (2, 60000, "60 secs"), (3, 899000, "15 mins"), (4, None, None),
    ]
    assert rows(apps.app_started(history, F.lit(61000).cast("bigint")), "app_id", "started")[0] == (1, "56 s ago")
    assert apps.app_attempts(history).count() == 6


def tasks_of(spark, rows):
    schema = "app_id bigint, job_id bigint, stage_id bigint, executor_id bigint, launch_ms bigint, duration_ms bigint, gc_ms bigint, state string"
    tasks = spark.createDataFrame(rows, schema)
    for name in [*apps.STAGE_METRICS, *apps.PHASES]:
        if name not in tasks.columns:
            tasks = tasks.withColumn(name, F.lit(2).cast("bigint"))
    return tasks


@pytest.fixture
def tasks(spark):
    return tasks_of(spark, [
        (1, 1, 1, 1, 0, 1000, 10, "completed"), (1, 1, 1, 2, 500, 2001, 10, "completed"),
        (1, 1, 2, 1, 3000, 100, 50, "failed"), (1, 2, 3, 1, 4000, 10, 0, "active"),
    ])


def test_jobs_and_attempts(tasks, rows):
    assert rows(apps.job_list(tasks), "job_id", "stages", "completed_stages", "runtime", "status") == [
        (1, 2, 1, "3.1 secs", "failed"), (2, 1, 0, "10 ms", "running"),
    ]
    assert rows(apps.attempt_metrics(tasks), "time_taken_ms", "avg_task_ms", "max_task_ms", "executor_ms", "gc_ms") == [
        (4010, 778, 2001, 3111, 70),
    ]
    assert rows(apps.runtime_counters(tasks)) == rows(apps.runtime_counters(tasks, approximate=True)) == [(1, 2, 2, 3, 4)]


def test_stage_summary_as_rows(tasks, rows):
    found = apps.stage_metric_rows(apps.stage_summary(tasks)).filter("stage_id = 1 AND name = 'duration_ms'")
    assert rows(found) == [(1, 1, "duration_ms", 1000, 1501, 2001, 3001)]


def test_stages_and_executors_of_two_applications_stay_apart(spark, rows):
    both = tasks_of(spark, [(1, 1, 0, 0, 0, 100, 1, "completed"), (2, 2, 0, 0, 0, 900, 1, "failed")])
    assert rows(apps.stage_summary(both), "app_id", "stage_id", "duration_ms_min", "duration_ms_max") == [(1, 0, 100, 100), (2, 0, 900, 900)]
    assert rows(apps.task_timeline(both.withColumn("compute", F.col("duration_ms"))), "app_id", "compute") == [(1, 100), (2, 900)]
    executors = spark.createDataFrame(
        [(1, 0, 2, 100, 50, 1)], "app_id bigint, executor_id bigint, cores bigint, max_memory bigint, used_memory bigint, disk_used bigint"
    )
    table = apps.executor_table(both, executors).filter("NOT is_total")
    assert rows(table, "app_id", "executor_id", "cores", "failed_tasks", "task_ms") == [(1, 0, 2, 0, 100), (2, 0, 0, 1, 900)]
    samples = spark.sql(
        "SELECT a AS app_id, 0 AS worker_id, 0 AS executor_id, timestamp_ntz'2024-01-01 00:10:00' AS ts, u AS used, 100L AS max_memory, "
        "CAST(NULL AS BIGINT) AS executor_cpu FROM VALUES (1, 10L), (2, 30L) AS v(a, u)"
    )
    assert rows(series.executors_overview(samples).filter("is_total"), "app_id", "executors", "storage_used") == [(1, 1, 10), (2, 1, 30)]
    assert rows(series.executor_summary(samples), "app_id", "avg_used") == [(1, 10), (2, 30)]
    assert series.worker_memory_series(samples).count() == 2


def test_executor_table_has_a_total(spark, tasks, rows):
    executors = spark.createDataFrame(
        [(1, 1, 2, 100, 50, 1), (1, 2, 4, 100, 25, 1), (1, 3, 4, 0, 0, 0)],
        "app_id bigint, executor_id bigint, cores bigint, max_memory bigint, used_memory bigint, disk_used bigint",
    )
    table = apps.executor_table(tasks, executors)
    assert rows(table, "executor_id", "is_total", "cores", "completed_tasks", "task_ms", "memory_percent") == [
        (1, False, 2, 1, 1110, 50), (2, False, 4, 1, 2001, 25), (3, False, 4, 0, 0, None), (None, True, 10, 2, 3111, 38),
    ]


def test_observations(tasks, rows):
    found = apps.runtime_observations(tasks, skew_percent=130, gc_percent=10)
    assert rows(found, "stage_id", "title", "severity") == [(1, "Task skew", 2), (2, "Failed tasks", 3), (2, "GC pressure", 1)]


@pytest.mark.parametrize("operator, value, unit, fires", [
    ("exceeds", 2, "secs", True), ("exceeds", 2001, "ms", False), ("equals", 2001, "ms", True), ("exceeds", 1, "mins", False),
    ("odd", 0, "ms", False), ("exceeds", 0, "odd", False),
])
def test_alert_rules(spark, tasks, operator, value, unit, fires):
    rules = spark.createDataFrame(
        [(7, 1, "maxTaskRuntime", operator, value, unit)],
        "alert_id bigint, job_id bigint, metric string, operator string, value int, unit string",
    )
    assert alerts.evaluate_alerts(alerts.alert_metrics(tasks), rules).count() == (1 if fires else 0)


def test_success_alert(spark, tasks, rows):
    rules = spark.createDataFrame(
        [(1, 1, "appFinalStatus", "equals", 0, "boolean"), (2, 2, "appFinalStatus", "equals", 0, "boolean")],
        "alert_id bigint, job_id bigint, metric string, operator string, value int, unit string",
    )
    assert rows(alerts.evaluate_alerts(alerts.alert_metrics(tasks), rules), "alert_id") == [(1,)]


def test_series(spark, rows):
    samples = spark.sql(
        "SELECT 1 AS app_id, 0 AS worker_id, e AS executor_id, timestamp_ntz'2024-01-01 00:10:00' + make_interval(0,0,0,0,h,0,0) AS ts, "
        "CAST(u AS BIGINT) AS used, 100L AS max_memory, r AS region, 4 AS cores, e AS tasks, c AS executor_cpu, CAST(NULL AS BIGINT) AS system_cpu "
        "FROM VALUES (1, 0, 10, 'eden', 50L), (1, 0, 30, 'eden', 51L), (2, 0, 5, 'old', NULL), (2, 1, 7, 'metaspace', 7L) AS v(e, h, u, r, c)"
    )
    memory = series.memory_series(samples).groupBy("series").agg(F.sum("value"))
    assert rows(memory) == [("cluster_max", 300), ("cluster_usage", 42), ("heap", 35), ("off_heap", 7)]
    assert rows(series.cpu_series(samples).filter("series = 'executor_cpu'"), "value") == [(51,), (7,)]
    assert rows(series.executors_overview(samples), "worker_id", "is_total", "executors", "peak_used", "allocated", "storage_used") == [
        (0, False, 2, 30, 200, 37), (None, True, 2, 30, 200, 37),
    ]
    points = series.worker_memory_series(samples).filter("executor_id = 2").first()["points"]
    assert [point["used"] for point in points] == [5, 7]


def test_statement_kinds(spark):
    texts = ["select 1", "  DROP table x", "alter table x", "insert\ninto t", "", "   ", None, "merge into t", "create"]
    df = spark.createDataFrame([(text,) for text in texts], "s string")
    assert [row["kind"] for row in query.statement_kind(df, "s").collect()] == [
        "query", "update", "query", "query", "invalid", "invalid", "invalid", "query", "update",
    ]
    assert [row["kind"] for row in query.statement_kind(df, "s", any_space=True).collect()][3] == "update"


@pytest.mark.parametrize("span_s", [1, 100, 10**9])
def test_runs_of_a_deployment_are_placed_newest_first(spark, span_s):
    """A deployment with most runs, runs that started together, and one that never started."""
    schema = "deployment_id bigint, run_id bigint, status string, trigger string, started timestamp_ntz, ended timestamp_ntz"
    start = datetime(2024, 1, 1)
    data = [(1 if n % 3 else n % 5, n, "succeeded", "manually", start + timedelta(seconds=n * 7919 % 300), None) for n in range(300)]
    data += [(1, 500, "running", "manually", None, None), (None, 501, "running", "manually", start, None)]
    found = apps.deployment_history(spark.createDataFrame(data, schema), F.lit(start).cast("timestamp_ntz"), span_s)
    expected = {}
    for one in sorted(data, key=lambda row: (row[4] is not None, row[4] or start, row[1]), reverse=True):
        expected.setdefault(one[0], []).append(one[1])
    got = {}
    for row in sorted(found.collect(), key=lambda row: row["position"]):
        got.setdefault(row["deployment_id"], []).append(row["run_id"])
    assert got == expected


def test_user_queries(spark):
    tables = {"numbers": spark.range(5)}
    assert query.run_query(spark, tables, "SELECT sum(id) AS s FROM numbers WHERE id > :low", {"low": 2}).first()["s"] == 7
    for bad in ["", "DELETE FROM numbers", "SELECT id, id FROM numbers"]:
        with pytest.raises(ValueError):
            query.run_query(spark, tables, bad)


def test_a_query_leaves_the_views_of_the_session_alone(spark, rows):
    spark.range(3).createOrReplaceTempView("numbers")
    tables = {"numbers": spark.range(10), "Odd name": spark.range(2)}
    assert query.run_query(spark, tables, "SELECT count(*) AS n FROM numbers;").first()["n"] == 10
    assert spark.table("numbers").count() == 3
    assert not spark.catalog.tableExists("`Odd name`")
    own = "WITH numbers AS (SELECT id FROM numbers WHERE id < 4), few AS (SELECT * FROM numbers) SELECT '{x}' AS x, max(id) AS id FROM few -- end"
    assert rows(query.run_query(spark, tables, own)) == [("{x}", 3)]
    ordered = query.run_query(spark, tables, "SELECT id FROM numbers ORDER BY id DESC LIMIT 2")
    assert [row["id"] for row in ordered.collect()] == [9, 8]
    assert query.run_query(spark, tables, "SELECT count(*) AS n FROM `Odd name`").first()["n"] == 2
    spark.catalog.dropTempView("numbers")
    assert query.run_query(spark, {}, "SELECT 1 AS n").first()["n"] == 1
