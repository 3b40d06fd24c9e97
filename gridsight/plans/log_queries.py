"""Log, error and page queries."""

from pyspark.sql import functions as F

from ..functions.times import moment
from ..operators import apps, html, logs
from ..sources.files import decode_yarn_metrics, decode_yarn_nodes
from . import bindings as b
from .binding_sql import pick
from .catalogue import query


def _logs(spark, folder):
    return logs.parse_log_lines(b.log_lines(spark, folder))


@query("L1", "SELECT log_offset, ts, level, thread, class_name, message FROM logs", ["logs"])
def parsed_log_lines(spark, folder):
    return _logs(spark, folder)


@query("L1", "SELECT event_id AS log_offset, 'broken line ' || event_id AS line FROM events WHERE event_id % 97 = 0")
def rejected_log_lines(spark, folder):
    return logs.reject_log_lines(b.log_lines(spark, folder))


@query(
    "L2",
    "SELECT log_offset, ts, level, thread, class_name, message FROM logs WHERE contains(message, ': 7') AND level IN ('ERROR', 'WARN') "
    "AND class_name IN ('org.app.error', 'org.app.signup') AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP "
    "'2024-01-20 00:00:00' AND log_offset > 2000",
    ["logs"],
)
def searched_logs(spark, folder):
    return logs.search_log_lines(
        b.log_lines(spark, folder), ": 7", ["ERROR", "WARN"], classes=["org.app.error", "org.app.signup"],
        start=moment("2024-01-05 00:00:00"), end=moment("2024-01-20 00:00:00"), last_offset=2000,
    )


@query(
    "L2",
    "SELECT log_offset, ts, level, thread, class_name, message FROM logs WHERE contains(message, '9') AND log_offset > 500 "
    "ORDER BY log_offset LIMIT 100",
    ["logs"],
)
def log_search_page(spark, folder):
    return logs.search_logs(_logs(spark, folder), "9", last_offset=500, n=100)


_FACET = "count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts, max(log_offset) AS last_offset FROM logs"


@query(
    "L3",
    f"SELECT 'all' AS facet, CAST(NULL AS VARCHAR) AS value, {_FACET} UNION ALL SELECT 'level', level, {_FACET} GROUP BY level "
    f"UNION ALL SELECT 'class', class_name, {_FACET} GROUP BY class_name",
    ["logs"],
)
def log_facets(spark, folder):
    return logs.log_facets(_logs(spark, folder))


@query(
    "L4",
    "SELECT thread, milestone, min(log_offset) AS log_offset, arg_min(ts, log_offset) AS ts, arg_min(message, log_offset) AS message "
    "FROM logs JOIN (VALUES ('first', '\"k\": 1'), ('second', '\"k\": 42'), ('third', '}')) v(milestone, marker) ON "
    "contains(message, marker) GROUP BY ALL",
    ["logs"],
)
def startup_milestones(spark, folder):
    return logs.startup_milestones(_logs(spark, folder), {"first": '"k": 1', "second": '"k": 42', "third": "}"})


_ERRORS = (
    f"(SELECT event_id, user_id, {pick('event_id', ['error', 'warn', 'fatal', 'info'])} AS severity, "
    f"{pick('user_id', ['code', 'runtime', 'code'])} AS source, 'cause-' || (user_id % 7) AS cause FROM events WHERE event_type = 'error')"
)


@query("L5", f"SELECT severity, source, cause, count(*) AS errors FROM {_ERRORS} GROUP BY ALL")
def error_rollup(spark, folder):
    return logs.error_rollup(b.errors(spark, folder))


@query(
    "L5",
    "SELECT cause, class_name, method_name, CAST(line_number AS INTEGER) AS line_number, count(*) AS occurrences FROM (SELECT cause, "
    "'org.app.C' || (event_id % 3) AS class_name, 'm' || p AS method_name, user_id % 5 + p AS line_number FROM "
    f"{_ERRORS}, (VALUES (0), (1)) v(p) WHERE p < event_id % 3 UNION ALL SELECT cause, NULL, NULL, NULL FROM {_ERRORS} "
    "WHERE event_id % 3 = 0) GROUP BY ALL",
)
def error_traces(spark, folder):
    return logs.error_traces(b.errors(spark, folder))


@query(
    "H4 S9",
    "SELECT page_id, position - 1 AS position, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS item FROM (SELECT page_id, "
    "unnest(items) AS item, generate_subscripts(items, 1) AS position FROM (SELECT page_id, regexp_extract_all(html, "
    "'(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1) AS items FROM pages))",
)
def list_items(spark, folder):
    return html.list_items(b.table(spark, folder, "pages").select("page_id", "html"))


def _summary(remainder: int) -> str:
    return (
        "SELECT s_suppkey AS page_id, 'spark://h' || s_suppkey || ':7077' AS url, CAST(s_suppkey % 3 AS INTEGER) AS alive_workers, "
        "CAST(s_suppkey % 5 AS INTEGER) AS cores_used, CAST(s_suppkey % 16 + 1 AS INTEGER) AS cores_total, (s_suppkey % 5) || '.0 B' AS "
        "memory_used, (s_suppkey % 16 + 1) || '.0 GiB' AS memory_total, CASE WHEN s_suppkey % 3 = 0 THEN 'STANDBY' ELSE 'ALIVE' END AS "
        f"status FROM supplier WHERE s_suppkey % 2 = {remainder}"
    )


@query("H1", _summary(0))
def master_summary_older_layout(spark, folder):
    return html.master_summary(b.master_pages(spark, folder), "3.0.3")


@query("H1", _summary(1))
def master_summary_newer_layout(spark, folder):
    return html.master_summary(b.master_pages(spark, folder), "3.2.0")


@query(
    "H2",
    "SELECT s_suppkey AS page_id, CAST(p AS BIGINT) AS position, 'worker-' || s_suppkey || '-' || p AS worker_id, '10.0.' || p || '.' || "
    f"(s_suppkey % 250) || ':6060' AS address, {pick('s_suppkey + p', ['ALIVE', 'DEAD', 'ALIVE'])} AS status, "
    "CAST(s_suppkey % 5 AS INTEGER) AS cores_used, CAST(s_suppkey % 16 + 1 AS INTEGER) AS cores_total, (s_suppkey % 5) || '.0 B' AS "
    "memory_used, (s_suppkey % 16 + 1) || '.0 GiB' AS memory_total FROM supplier, (VALUES (0), (1)) v(p)",
)
def worker_rows(spark, folder):
    return html.worker_rows(b.master_pages(spark, folder))


@query("H3", "SELECT s_suppkey AS page_id, s_suppkey % 14 AS running_apps, s_suppkey % 120 AS completed_apps FROM supplier")
def app_counts(spark, folder):
    return html.app_counts(b.master_pages(spark, folder))


@query(
    "A27",
    "SELECT cluster_id, count(*) FILTER (alive) AS alive_masters, count(*) FILTER (NOT alive) AS standby_masters, "
    "CAST(sum(CASE WHEN alive THEN used ELSE 0 END) AS BIGINT) AS cores_used, CAST(sum(CASE WHEN alive THEN total ELSE 0 END) AS BIGINT) "
    "AS cores_total, CAST(sum(workers) AS BIGINT) AS alive_workers FROM (SELECT s_suppkey // 4 AS cluster_id, s_suppkey % 3 <> 0 AS alive, "
    "s_suppkey % 5 AS used, s_suppkey % 16 + 1 AS total, CASE WHEN s_suppkey % 3 = 2 THEN 2 ELSE 1 END AS workers FROM supplier) "
    "GROUP BY cluster_id",
)
def master_overview(spark, folder):
    pages = b.master_pages(spark, folder)
    cluster = F.call_function("div", F.col("page_id"), F.lit(4)).alias("cluster_id")
    masters = html.master_summary(pages, "3.0.3").unionByName(html.master_summary(pages, "3.2.0"))
    return apps.master_overview(masters.select(cluster, "*"), html.worker_rows(pages).select(cluster, "*"))


@query(
    "A26 S11",
    "SELECT s_suppkey AS cluster_id, s_suppkey % 50 AS apps_completed, s_suppkey % 7 AS apps_running, s_suppkey % 3 AS apps_pending, "
    "s_suppkey % 2 AS apps_killed FROM supplier",
)
def yarn_applications(spark, folder):
    answers = b.yarn_answers(spark, folder).select("cluster_id", F.col("metrics").alias("json"))
    return apps.yarn_applications(decode_yarn_metrics(answers))


@query(
    "A26 S11",
    "SELECT cluster_id, node_id, grouping(node_id) = 1 AS is_total, CAST(sum(u) AS BIGINT) AS used_memory_mb, CAST(sum(8192) AS BIGINT) "
    "AS available_memory_mb, CAST(sum(c) AS BIGINT) AS used_cores, CAST(sum(a) AS BIGINT) AS available_cores FROM (SELECT s_suppkey AS "
    "cluster_id, 'node-' || s_suppkey || ':' || p AS node_id, s_suppkey % 64 * 100 + p AS u, s_suppkey % 8 AS c, 8 + p AS a "
    "FROM supplier, (VALUES (0), (1)) v(p)) GROUP BY GROUPING SETS ((cluster_id), (cluster_id, node_id))",
)
def yarn_overview(spark, folder):
    answers = b.yarn_answers(spark, folder).select("cluster_id", F.col("nodes").alias("json"))
    return apps.yarn_overview(decode_yarn_nodes(answers))
