"""The bindings again, in SQL for the checking engine, and its text formats.

Written from the definitions, not from the Spark code, so that a mistake in
one shows up against the other.
"""

from __future__ import annotations

from collections.abc import Iterable

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def pick(index: str, values: Iterable[str | None]) -> str:
    values = list(values)
    listed = ", ".join("NULL" if value is None else "'" + value + "'" for value in values)
    return f"list_extract([{listed}], CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def rounded(value: str) -> str:
    return f"CAST(round({value}) AS BIGINT)"


def half_up(value: str, unit: str | int, scale: int = 1) -> str:
    return f"((CAST({2 * scale} AS BIGINT) * ({value}) + ({unit})) // (CAST(2 AS BIGINT) * ({unit})))"


def half_down(value: str, unit: str | int, scale: int = 1) -> str:
    return f"((CAST({2 * scale} AS BIGINT) * ({value}) + ({unit}) - 1) // (CAST(2 AS BIGINT) * ({unit})))"


def tenths(number: str) -> str:
    return f"(({number}) // 10) || '.' || (({number}) % 10)"


def mean(total: str, count: str) -> str:
    return f"CAST(CASE WHEN {count} > 0 THEN {half_up(total, f'nullif({count}, 0)')} END AS BIGINT)"


SECOND, MINUTE, HOUR, DAY, MONTH, YEAR = 1000, 60000, 3600000, 86400000, 2592000000, 31536000000


def interval_ms(ms: str) -> str:
    """X2."""
    return (
        f"CASE WHEN {ms} < {SECOND} THEN {ms} || ' ms' WHEN {ms} < {MINUTE} THEN {half_up(ms, SECOND)} || ' s' "
        f"WHEN {ms} < {HOUR} THEN {half_down(ms, MINUTE)} || ' m' "
        f"WHEN {ms} < {DAY} THEN {tenths(half_down(ms, HOUR, 10))} || ' h' "
        f"WHEN {ms} < {MONTH} THEN {half_down(ms, DAY)} || ' d' "
        f"WHEN {ms} < {YEAR} THEN ({ms} // {MONTH}) || ' mo' ELSE ({ms} // {YEAR}) || ' y' END"
    )


def interval_ms_decimal(ms: str) -> str:
    """X3."""
    return (
        f"CASE WHEN {ms} < {SECOND} THEN {ms} || ' ms' WHEN {ms} < {MINUTE} THEN {tenths(half_up(ms, SECOND, 10))} || ' s' "
        f"WHEN {ms} < {HOUR} THEN {tenths(half_down(ms, MINUTE, 10))} || ' m' "
        f"WHEN {ms} < {DAY} THEN {tenths(half_down(ms, HOUR, 10))} || ' h' "
        f"WHEN {ms} < {MONTH} THEN {half_down(ms, DAY)} || ' d' "
        f"WHEN {ms} < {YEAR} THEN ({ms} // {MONTH}) || ' mo' ELSE ({ms} // {YEAR}) || ' y' END"
    )


def interval_ms_days(ms: str) -> str:
    """X4."""
    return (
        f"CASE WHEN {ms} < {SECOND} THEN {ms} || ' ms' WHEN {ms} < {MINUTE} THEN {tenths(half_up(ms, SECOND, 10))} || ' s' "
        f"WHEN {ms} < {HOUR} THEN {tenths(half_up(ms, MINUTE, 10))} || ' m' "
        f"WHEN {ms} < {DAY} THEN {tenths(half_up(ms, HOUR, 10))} || ' h' ELSE {tenths(half_up(ms, DAY, 10))} || ' d' END"
    )


def readable_time(ms: str) -> str:
    """X12."""

    def shown(unit: int, label: str) -> str:
        number = half_up(ms, unit, 10)
        return f"CASE WHEN {number} % 10 = 0 THEN CAST({number} // 10 AS VARCHAR) ELSE {tenths(number)} END || ' {label}'"

    return (
        f"CASE WHEN {ms} > {DAY} THEN {shown(DAY, 'days')} WHEN {ms} > {HOUR} THEN {shown(HOUR, 'hrs')} "
        f"WHEN {ms} > {MINUTE} THEN {shown(MINUTE, 'mins')} WHEN {ms} > {SECOND} THEN {shown(SECOND, 'secs')} "
        f"ELSE {ms} || ' ms' END"
    )


def interval_s(seconds: str) -> str:
    """X1."""
    return (
        f"CASE WHEN {seconds} < 60 THEN {seconds} || ' secs' WHEN {seconds} < 3600 THEN ({seconds} // 60) || ' mins' "
        f"WHEN {seconds} < 86400 THEN ({seconds} // 3600) || ' hrs' WHEN {seconds} < 2592000 THEN ({seconds} // 86400) || ' days' "
        f"WHEN {seconds} < 31536000 THEN ({seconds} // 2592000) || ' mon' ELSE ({seconds} // 31536000) || ' yrs' END"
    )


def elapsed(start: str, end: str) -> str:
    return f"((epoch_us({end}) // 1000) - (epoch_us({start}) // 1000))"


def _size(size: str, divisor: int) -> str:
    text = f"CASE WHEN {size} = 0 THEN '0 B' WHEN {size} < 1024 THEN {size} || ' Bytes'"
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        shown = tenths(half_up(f"CAST({size} AS HUGEINT)", divisor**power, 10)) + f" || ' {unit}'"
        text += f" WHEN {size} < {1024 ** (power + 1)} THEN {shown}" if power < 4 else f" ELSE {shown}"
    return text + " END"


def bytes_to_size(size: str) -> str:
    """X7."""
    return _size(size, 1024)


def bytes_to_decimal_size(size: str) -> str:
    """X8."""
    return _size(size, 1000)


def readable_size(size: str) -> str:
    """X6, for amounts from 0 to below a pebibyte: the first unit whose text, rounded to tenths, stays below 1024.0."""
    text = f"CASE WHEN {size} < 1024 THEN {size} || ' B'"
    for power, letter in enumerate("KMGT"):
        rounded = f"((CAST({size} AS HUGEINT) // {1024**power}) * 20 + 1024) // 2048"
        text += f" WHEN {rounded} < 10240 THEN {tenths(rounded)} || ' {letter}B'"
    return text + " END"


SERVICES = ["spark", "kafka", "hadoop"]
VERSIONS = ["3.2.0", "2.8.1", "3.3.1"]
STATES = ["new", "downloading", "starting", "running", "terminated", "inactive", "deleted"]
PROVIDERS = ["local", "sandbox", "sandbox-docker", "spark-standalone", "yarn"]
NAMES = ["Master", "Worker", "History_Server"]
POLICIES = [
    "workspace.manage:workspace.manageClusters", "workspace.read", "org.manage:org.billing", "WORKSPACE.READ:bogus",
]

# name -> (bindings it reads, definition)
BINDINGS: dict[str, tuple[list[str], str]] = {
    "topic_log": (
        [],
        "SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition_id, event_id AS log_offset, "
        "(epoch_us(ts) // 1000) AS ts_ms, CAST(user_id AS VARCHAR) AS msg_key, props AS message, length(props) AS size FROM events",
    ),
    "offsets": (
        ["topic_log"],
        "SELECT topic, partition_id, min(log_offset) AS start_offset, max(log_offset) + 1 AS end_offset, "
        "max(log_offset) + 1 - min(log_offset) AS messages FROM topic_log GROUP BY ALL",
    ),
    "replicas": (
        ["topic_log"],
        "SELECT topic, partition_id, CAST((partition_id + r) % 3 AS INTEGER) AS broker_id, r = 0 AS leader, "
        "NOT (r = 1 AND partition_id = 3) AS in_sync, size FROM (SELECT topic, partition_id, CAST(sum(size) AS BIGINT) AS size "
        "FROM topic_log GROUP BY ALL), (VALUES (0), (1)) v(r)",
    ),
    "assignments": (
        ["offsets"],
        "SELECT 'g' || g AS group_id, 'client-' || (partition_id % 2) AS member, topic, partition_id, g, end_offset, "
        "CASE WHEN NOT (g = 2 AND partition_id = 3) THEN end_offset * (g + 1) // 4 END AS committed_offset "
        "FROM offsets, (VALUES (0), (1), (2)) v(g)",
    ),
    "files": (
        [],
        "SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id || '.txt' WHEN doc_id % 97 = 0 THEN source || '/' || lang || '/' || doc_id "
        "|| '/' ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS name, n_chars AS size, "
        "doc_id + 1700000000 AS last_modified, 'owner' || (doc_id % 3) AS owner FROM documents",
    ),
    "clusters": (
        [],
        f"SELECT c_custkey AS id, c_name AS name, c_nationkey AS workspace_id, {pick('c_custkey', SERVICES)} AS service_name, "
        f"{pick('c_custkey', VERSIONS)} AS service_version, 'pc-' || c_custkey AS provider_cluster_id, "
        f"{pick('c_custkey', STATES)} AS status, {pick('c_custkey', PROVIDERS)} AS provider, "
        f"{NOW} - to_hours(c_custkey % 20000) AS dt_added, {NOW} - to_seconds(c_custkey % 300) AS last_updated FROM customer",
    ),
    "services": (
        [],
        f"SELECT c_custkey AS cluster_id, {pick('c_custkey', SERVICES)} AS service_name, {pick('c_custkey', VERSIONS)} AS version, "
        "CASE c_custkey % 3 WHEN 0 THEN '2.12' WHEN 1 THEN '2.13' END AS scala_version, "
        "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'spark.executor.cores 2' || chr(10) || 'spark.executor.memory ' "
        "|| (c_custkey % 8 + 1) || 'g' END AS configuration_params FROM customer",
    ),
    "processes": (
        [],
        f"SELECT o_custkey AS cluster_id, {pick('o_orderkey', NAMES)} AS name, '10.0.0.' || (o_orderkey % 250) AS host_ip, "
        "CAST(o_orderkey % 1000 + 7000 AS INTEGER) AS port, CASE o_orderstatus WHEN 'F' THEN 'stopped' WHEN 'O' THEN 'running' "
        "ELSE 'starting' END AS status, o_orderkey AS pid FROM orders",
    ),
    "workspaces": (
        [],
        f"SELECT n_nationkey AS id, n_name AS name, n_regionkey AS org_id, {NOW} - to_days(n_nationkey) AS dt_created FROM nation",
    ),
    "requests": (
        [],
        "SELECT c_custkey AS request_id, c_nationkey AS workspace_id, CASE WHEN c_custkey % 4 = 0 THEN c_name "
        "ELSE 'new-' || (c_custkey // 10) END AS name FROM customer",
    ),
    "profiles": (
        [],
        "SELECT s_suppkey AS member_id, n_regionkey AS org_id, s_nationkey AS workspace_id, "
        f"{pick('s_suppkey', ['dark', 'light'])} AS web_theme, 'light' AS desktop_theme "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "policies": (
        ["profiles"],
        "SELECT member_id, CASE WHEN member_id % 4 = 2 THEN 'org' ELSE 'workspace' END AS subject_type, "
        "CASE WHEN member_id % 4 = 2 THEN org_id ELSE workspace_id END + CASE WHEN member_id % 10 = 0 THEN 1 ELSE 0 END AS subject_id, "
        "policy FROM profiles JOIN (VALUES (0, 'workspace.manage'), (0, 'workspace.manageClusters'), (1, 'workspace.read'), "
        "(2, 'org.manage'), (2, 'org.billing'), (3, 'workspace.read')) v(k, policy) ON member_id % 4 = k",
    ),
    "packages": (
        [],
        "SELECT p_partkey AS id, p_brand AS name, p_size || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 11 = 0 THEN '' "
        "ELSE '.' || (p_partkey % 3) END AS version, p_partkey % 7 = 0 AS is_deprecated FROM part",
    ),
    "logs": (
        [],
        "SELECT event_id AS log_offset, date_trunc('millisecond', ts) AS ts, CASE event_type WHEN 'error' THEN 'ERROR' "
        "WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level, 't-' || (user_id % 4) AS thread, "
        "'org.app.' || event_type AS class_name, props AS message FROM events WHERE event_id % 97 <> 0",
    ),
    "tasks": (
        [],
        "SELECT (l_orderkey % 40) // 8 AS app_id, (l_orderkey % 40) // 4 AS job_id, l_orderkey % 8 AS stage_id, "
        f"l_suppkey % 8 AS executor_id, (epoch_us(l_shipdate) // 1000) AS launch_ms, {rounded('l_quantity * 1000')} AS duration_ms, "
        f"{rounded('l_tax * 10000')} AS gc_ms, {rounded('l_extendedprice * 100')} AS input_bytes, "
        "CAST(l_linenumber AS BIGINT) AS input_records, l_partkey * 10 AS output_bytes, "
        "CAST(l_linenumber AS BIGINT) AS output_records, l_partkey * 3 AS shuffle_read_bytes, "
        "CAST(l_linenumber AS BIGINT) AS shuffle_read_records, l_suppkey * 3 AS shuffle_write_bytes, "
        "CAST(l_linenumber AS BIGINT) AS shuffle_write_records, CAST(l_linenumber AS BIGINT) AS scheduler_delay, "
        f"{rounded('l_quantity * 1000')} AS compute, l_partkey % 100 AS shuffle_read_time, l_suppkey % 100 AS shuffle_write_time, "
        "l_orderkey % 7 AS getting_result, l_orderkey % 5 AS deserialise, l_orderkey % 3 AS serialise, "
        "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'active' END AS state FROM lineitem",
    ),
    "samples": (
        [],
        "SELECT user_id % 6 AS app_id, user_id % 8 % 3 AS worker_id, user_id % 8 AS executor_id, ts, "
        f"{rounded('value * 100')} AS used, CAST(60000 AS BIGINT) AS max_memory, CASE event_type WHEN 'click' THEN 'eden' "
        "WHEN 'view' THEN 'old' WHEN 'purchase' THEN 'survivor' WHEN 'signup' THEN 'metaspace' ELSE 'code_cache' END AS region, "
        f"user_id % 8 + 1 AS cores, user_id % 5 AS tasks, CASE WHEN user_id % 2 = 0 THEN {rounded('value')} % 100 END AS executor_cpu, "
        f"CASE WHEN user_id % 2 = 1 THEN {rounded('value')} % 100 END AS system_cpu FROM events",
    ),
    "attempts": (
        [],
        "SELECT o_orderkey AS app_id, 'app-' || o_orderkey AS name, CAST(i AS BIGINT) AS position, "
        "CAST(i + 1 AS VARCHAR) AS attempt_id, (epoch_us(o_orderdate) // 1000) - i * 7200000 AS start_ms, "
        "CASE WHEN i = 0 AND o_orderstatus = 'P' THEN -1 ELSE (epoch_us(o_orderdate) // 1000) - i * 7200000 + (o_orderkey % 5000) * 1000 + 500 "
        "END AS end_ms, NOT (i = 0 AND o_orderstatus = 'P') AS completed, CASE WHEN i = 0 AND o_orderstatus = 'P' THEN 0 "
        "ELSE (o_orderkey % 5000) * 1000 + 500 END AS duration_ms, 'u' || (o_orderkey % 9) AS spark_user "
        "FROM orders, (VALUES (0), (1), (2)) v(i) WHERE i <= o_orderkey % 3",
    ),
    "status_events": (
        [],
        "SELECT user_id AS cluster_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'starting' "
        "WHEN 'purchase' THEN 'new' WHEN 'signup' THEN 'terminating' ELSE 'terminated' END AS status FROM events",
    ),
}


def with_bindings(names: Iterable[str], body: str) -> str:
    """The body with the named bindings, and those they read, in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in BINDINGS[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{name} AS ({BINDINGS[name][1]})" for name in ordered) + " " + body
