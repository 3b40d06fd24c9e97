"""Streams run over the whole event table until it is used up."""


from ..operators import kafka
from ..sources.topics import stream_files
from ..storage import new_folder
from ..streaming import running, views
from . import bindings as b
from .app_queries import _FIRES, _METRICS, _RULES
from .binding_sql import bytes_to_size, half_up
from .catalogue import query


def _stream(spark, folder, name):
    """The table as a stream; the pattern matches a single file and a folder of files."""
    return stream_files(spark, b.table(spark, folder, name).schema, f"{folder}/{name}.parque[t]")


def _appended(spark, stream, name):
    place = new_folder(spark, name)
    running.start_append(stream, place).awaitTermination()
    return running.appended(spark, place, stream.schema)


def _kept(spark, started):
    running_query, table = started
    running_query.awaitTermination()
    return table.now(spark)


@query(
    "T1",
    "SELECT cluster_id, max(ts) AS ts, arg_max(status, (ts, seq)) AS status FROM status_events GROUP BY cluster_id",
    ["status_events"],
)
def latest_state_stream(spark, folder):
    stream = views.latest_state(b.status_of(_stream(spark, folder, "events")))
    return _kept(spark, views.start_keyed(stream, new_folder(spark, "latest-state"), views.LATEST_STATE))


@query(
    "T2",
    "SELECT cluster_id, min(ts) AS active_from, max(ts) AS last_heartbeat, max(ts) + INTERVAL 120 SECOND AS idle_from, count(*) AS "
    "heartbeats FROM (SELECT *, sum(fresh) OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS session FROM (SELECT *, CASE WHEN ts - "
    "lag(ts) OVER (PARTITION BY cluster_id ORDER BY ts, seq) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS fresh FROM status_events)) "
    "GROUP BY cluster_id, session HAVING max(ts) + INTERVAL 120 SECOND <= (SELECT max(ts) FROM status_events)",
    ["status_events"],
)
def idle_stream(spark, folder):
    return _kept(spark, views.start_idle(b.status_of(_stream(spark, folder, "events")), new_folder(spark, "idle")))


_PROCESS_STATUS = "CASE WHEN event_type IN ('view', 'click') THEN 'running' ELSE 'stopped' END"


# The status of each of the three processes as it stands after every change, and the last time all known ones agree.
_STANDING = ", ".join(
    f"last_value(CASE WHEN event_id % 3 = {n} THEN {_PROCESS_STATUS} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS "
    "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for n in range(3)
)


@query(
    "T3",
    "SELECT cluster_id, coalesce(arg_max(CASE standing[1] WHEN 'stopped' THEN 'terminated' ELSE standing[1] END, (ts, event_id)) FILTER "
    "(len(standing) = 1), 'unknown') AS status FROM (SELECT user_id AS cluster_id, ts, event_id, "
    f"list_distinct([{_STANDING}]) AS standing FROM events) GROUP BY cluster_id",
)
def rollup_stream(spark, folder):
    changes = b.process_changes_of(_stream(spark, folder, "events"))
    return _kept(spark, views.start_rollup(changes, new_folder(spark, "rollup")))


@query(
    "T4 X9 X13",
    f"SELECT cluster_id, ts, done, CAST(60000 AS BIGINT) AS total, {half_up('done', 60000, 100)} AS percent, {bytes_to_size('done')} AS "
    f"done_text, {bytes_to_size('60000')} AS total_text FROM (SELECT user_id AS cluster_id, max(ts) AS ts, "
    "arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS done FROM events WHERE round(value * 100) > 0 GROUP BY user_id)",
)
def progress_stream(spark, folder):
    stream = views.progress_stream(b.progress_of(_stream(spark, folder, "events")))
    return _kept(spark, views.start_keyed(stream, new_folder(spark, "progress"), views.PROGRESS))


_BEFORE = "OVER (PARTITION BY cluster_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "T5",
    "SELECT cluster_id, ts, seq, status FROM (SELECT s.*, a.status AS anchor FROM (SELECT *, "
    f"max(CASE WHEN status IN ('starting', 'terminating') THEN n END) {_BEFORE} AS anchor_n, max(CASE WHEN status = 'running' THEN n END) "
    f"{_BEFORE} AS ran_n, max(CASE WHEN status IN ('new', 'terminated') THEN n END) {_BEFORE} AS ended_n FROM numbered) s LEFT JOIN "
    "numbered a ON a.cluster_id = s.cluster_id AND a.n = s.anchor_n) WHERE NOT coalesce((anchor = 'starting' AND status IN ('new', "
    "'terminated') AND coalesce(ran_n, 0) < anchor_n) OR (anchor = 'terminating' AND status = 'running' AND coalesce(ended_n, 0) < "
    "anchor_n), false)".replace(
        "FROM numbered) s", "FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS n FROM status_events)) s"
    ).replace(
        "LEFT JOIN numbered a", "LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS n FROM status_events) a"
    ),
    ["status_events"],
)
def believed_changes_stream(spark, folder):
    return _kept(spark, views.start_believed(b.status_of(_stream(spark, folder, "events")), new_folder(spark, "believed")))


MAX_RETRY, RETRY_S = 3, 3600


@query(
    "T6",
    "SELECT cluster_id, process, CASE WHEN g IS NOT NULL THEN 'stopped' ELSE last_status END AS status, coalesce(g, last_ts) AS last_ts, "
    f"(SELECT count(*) FROM checks d WHERE d.cluster_id = k.cluster_id AND d.process = k.process AND NOT d.alive AND d.ts + to_seconds({RETRY_S}) "
    "<= coalesce(k.g, (SELECT max(ts) FROM checks ))) AS restarts_used, g AS given_up_at FROM (SELECT cluster_id, process, max(ts) AS last_ts, arg_max(CASE WHEN "
    "alive THEN 'running' ELSE 'stopped' END, (ts, seq)) AS last_status, (SELECT min(t.ts) FROM checks t WHERE t.cluster_id = c.cluster_id AND "
    "t.process = c.process AND NOT t.alive AND (SELECT count(*) FROM checks d WHERE d.cluster_id = t.cluster_id AND d.process = t.process AND "
    f"NOT d.alive AND d.ts + to_seconds({RETRY_S}) <= t.ts) >= {MAX_RETRY}) AS g FROM checks c GROUP BY cluster_id, process) k".replace(
        "checks ", "(SELECT user_id AS cluster_id, list_extract(['Master', 'Worker', 'History_Server'], CAST(event_id % 3 AS INTEGER) + 1) AS "
        "process, ts, event_id AS seq, event_type NOT IN ('error', 'signup') AS alive FROM events) "
    ),
)
def restart_budget_stream(spark, folder):
    checks = b.checks_of(_stream(spark, folder, "events"))
    return _kept(spark, views.start_restart_budget(checks, new_folder(spark, "restarts"), MAX_RETRY, RETRY_S))


@query(
    "T7",
    "SELECT topic, position, partition_id, log_offset, ts_ms, msg_key FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts_ms "
    "DESC, partition_id, log_offset) AS position FROM topic_log JOIN offsets USING (topic, partition_id) WHERE log_offset >= end_offset - "
    "600) WHERE position <= 600",
    ["topic_log", "offsets"],
)
def tail_topic_stream(spark, folder):
    tail = _kept(spark, views.start_tail(b.topic_log_of(_stream(spark, folder, "events")), new_folder(spark, "tail"), 600))
    return kafka.peek_latest(tail, 600).select("topic", "position", "partition_id", "log_offset", "ts_ms", "msg_key")


_SPAN = "time_bucket(INTERVAL 30 DAY, make_timestamp(launch_ms * 1000), TIMESTAMP '1970-01-01 00:00:00')"


@query(
    "T8",
    "SELECT window_start, job_id, alert_id, metric, operator, measured, CAST(lim AS BIGINT) AS \"limit\" FROM ("
    + " UNION ALL ".join(
        f"SELECT {_SPAN} AS window_start, job_id, '{name}' AS metric, CAST({value} AS BIGINT) AS measured FROM tasks GROUP BY 1, 2"
        for name, value in _METRICS.items()
    )
    + f") JOIN {_RULES} USING (job_id, metric) WHERE {_FIRES} AND window_start + INTERVAL 30 DAY <= "
    "(SELECT make_timestamp(max(launch_ms) * 1000) FROM tasks)",
    ["tasks"],
)
def alert_stream(spark, folder):
    tasks = b.tasks_of(_stream(spark, folder, "lineitem"))
    return _appended(spark, views.alert_stream(tasks, b.alert_rules(spark, folder), "30 days"), "alerts")


_WINDOW = "count(*) AS samples, max(used) AS max_used, CAST(sum(used) AS BIGINT) AS total_used FROM"


@query(
    "T9",
    f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, region, {_WINDOW} samples GROUP BY "
    "1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM samples)".replace(
        "HAVING date_trunc('day', ts)", "HAVING min(date_trunc('day', ts))"
    ),
    ["samples"],
)
def metric_windows_stream(spark, folder):
    return _appended(spark, views.metric_windows(b.samples_of(_stream(spark, folder, "events")), "1 day"), "windows")


@query(
    "T9",
    f"SELECT start AS window_start, start + INTERVAL 2 HOUR AS window_end, region, {_WINDOW} (SELECT *, date_trunc('hour', ts) - to_hours(h) "
    "AS start FROM samples, (VALUES (0), (1)) v(h)) GROUP BY start, region HAVING start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM samples)",
    ["samples"],
)
def sliding_windows_stream(spark, folder):
    stream = views.metric_windows(b.samples_of(_stream(spark, folder, "events")), "2 hours", "1 hour")
    return _appended(spark, stream, "sliding")
