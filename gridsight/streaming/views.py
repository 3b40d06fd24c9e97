"""Streaming operators.

``status`` streams have cluster_id, ts, seq and status; ``samples`` streams the
columns described in ``operators.series``; ``tasks`` streams those in
``operators.apps``. Event times are wall-clock UTC; watermarks need an instant,
so times are converted on the way in and back on the way out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.numbers import percent
from ..functions.parsing import parse_progress
from ..functions.sizes import bytes_to_size
from ..operators.alerts import alert_metrics, evaluate_alerts
from ..operators.kafka import latest_window
from . import restarts, rollups, sessions, transitions
from .running import LoggedTable, newest_of, staged, start_batches, touched, upsert


def instant(ts: str) -> Column:
    """The instant at which a UTC clock shows the wall-clock time."""
    return F.col(ts).cast("timestamp")


def wall_clock(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def schema_of(text: str) -> StructType:
    return StructType.fromDDL(text)


def latest_state(status: DataFrame) -> DataFrame:
    """Newest status of each cluster."""
    newest = F.max_by(F.struct("ts", "status"), F.struct("ts", "seq")).alias("newest")
    return status.groupBy("cluster_id").agg(newest).select("cluster_id", "newest.ts", "newest.status")


# Fixed value: how often readers of cluster state look again.
REFRESH_EVERY = "2 seconds"
LATEST_STATE = "cluster_id bigint, ts timestamp_ntz, status string"


def progress_stream(status: DataFrame) -> DataFrame:
    """T4: newest download progress of each cluster.

    Details that are not two positive numbers are passed over.
    """
    parsed = status.withColumn("progress", parse_progress(F.col("status_detail"))).filter(
        (F.col("progress.done") > 0) & (F.col("progress.total") > 0)
    )
    newest = parsed.groupBy("cluster_id").agg(
        F.max_by(F.struct("ts", "progress.done", "progress.total"), F.struct("ts", "seq")).alias("newest")
    )
    done, total = F.col("newest.done"), F.col("newest.total")
    return newest.select(
        "cluster_id",
        "newest.ts",
        done.alias("done"),
        total.alias("total"),
        percent(done, total).alias("percent"),
        bytes_to_size(done).alias("done_text"),
        bytes_to_size(total).alias("total_text"),
    )


PROGRESS = (
    "cluster_id bigint, ts timestamp_ntz, done bigint, total bigint, percent bigint, done_text string, total_text string"
)


def start_keyed(stream: DataFrame, folder: str, schema: str, every: str | None = None) -> tuple[StreamingQuery, LoggedTable]:
    """Keeps one row per cluster of an updating stream in a table; a batch writes the clusters it changed."""
    table = LoggedTable(f"{folder}/table", schema_of(schema), newest_of(["cluster_id"]))
    return start_batches(stream, upsert(table), folder, "update", every), table


CLOCK = "clock timestamp_ntz"


def _clock_table(folder: str) -> LoggedTable:
    """The newest event time of a stream."""
    return LoggedTable(f"{folder}/clock", schema_of(CLOCK), lambda rows: rows.agg(F.max("clock").alias("clock"), F.max("batch").alias("batch")))


def start_idle(
    status: DataFrame, folder: str, gap_s: int = 120, delay_s: int = 0, every: str | None = None
) -> tuple[StreamingQuery, LoggedTable]:
    """A row each time a cluster has been silent for longer than the gap, as described in ``sessions``.

    A batch writes the spells that are over, and the open spells of the clusters where they changed.
    """
    rows = LoggedTable(f"{folder}/rows", schema_of(sessions.IDLE_SCHEMA))
    carried = LoggedTable(f"{folder}/open", schema_of(sessions.OPEN_SCHEMA), newest_of(["cluster_id"]))
    clock = _clock_table(folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = staged(sessions.windows(batch, gap_s), folder, batch_id)
        was = clock.before(spark, batch_id).scalar()
        clock.write(arrived.agg(F.max("last_heartbeat").alias("clock")).union(clock.before(spark, batch_id)).agg(F.max("clock").alias("clock")), batch_id)
        had = carried.before(spark, batch_id)
        # a window that ends in time may still hold late heartbeats, which then belong to no other spell
        fresh = arrived.where(~F.coalesce(sessions.is_over(was, gap_s, delay_s), F.lit(False)))
        judged = sessions.spells(fresh.unionByName(sessions.opened(had)), gap_s)
        over = sessions.is_over(clock.now(spark).scalar(), gap_s, delay_s)
        judged = staged(judged.withColumn("over", F.coalesce(over, F.lit(False))), f"{folder}/judged", batch_id)
        rows.write(sessions.idle_rows(judged.where("over"), gap_s), batch_id)
        carried.write(sessions.carried_on(had, judged), batch_id)

    return start_batches(status, step, folder, every=every), rows


def metric_windows(samples: DataFrame, size: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Samples, largest and total use of each memory region per window; late rows are dropped."""
    timed = samples.withColumn("at", instant("ts")).withWatermark("at", delay)
    windows = timed.groupBy(F.window("at", size, slide).alias("span"), "region").agg(
        F.count(F.lit(1)).alias("samples"), F.max("used").alias("max_used"), F.sum("used").alias("total_used")
    )
    return windows.select(
        wall_clock(F.col("span.start")).alias("window_start"),
        wall_clock(F.col("span.end")).alias("window_end"),
        "region", "samples", "max_used", "total_used",
    )


def alert_stream(tasks: DataFrame, rules: DataFrame, size: str, delay: str = "0 seconds") -> DataFrame:
    """Alert rules on each window of a task stream.

    A window is finished once, so a rule fires at most once per window. Rules
    are a table read once per micro-batch; the join is on job and metric.
    """
    timed = tasks.withColumn("at", F.timestamp_millis("launch_ms")).withWatermark("at", delay)
    metrics = alert_metrics(timed, F.window("at", size).alias("span"))
    fired = evaluate_alerts(metrics, rules)
    return fired.select(
        wall_clock(F.col("span.start")).alias("window_start"),
        "job_id", "alert_id", "metric", "operator", "measured", "limit",
    )


PROCESS_STATE = "cluster_id bigint, name string, ts timestamp_ntz, seq bigint, status string"
ROLLUP = "cluster_id bigint, status string"


def start_rollup(changes: DataFrame, folder: str, every: str | None = None) -> tuple[StreamingQuery, LoggedTable]:
    """State of each cluster, kept up to date from the changes of its processes.

    ``changes`` has cluster_id, name, ts, seq and status. The state follows the
    changes one by one, so it does not depend on how they fall into batches, as
    long as the changes of a cluster arrive in order; one older than the newest
    of its process is passed over. A cluster whose known processes disagree
    keeps its state, ``unknown`` at first. A batch writes the processes and
    clusters it has changes of.
    """
    processes = LoggedTable(f"{folder}/processes", schema_of(PROCESS_STATE), newest_of(rollups.PROCESS))
    clusters = LoggedTable(f"{folder}/clusters", schema_of(ROLLUP), newest_of(["cluster_id"]))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = staged(batch, folder, batch_id)
        before = touched(processes.before(spark, batch_id), arrived, ["cluster_id"])
        known = touched(before, arrived, rollups.PROCESS)
        processes.write(rollups.newest_changes(known, arrived), batch_id)
        had = touched(clusters.before(spark, batch_id), arrived, ["cluster_id"])
        states = rollups.last_agreed(before, arrived)
        clusters.write(rollups.carried_on(had, states), batch_id)

    return start_batches(changes, step, folder, every=every), clusters


def start_believed(status: DataFrame, folder: str, every: str | None = None) -> tuple[StreamingQuery, LoggedTable]:
    """T5: status changes without leftovers; the rows of many batches share a part, so that parts stay few."""
    rows = LoggedTable(f"{folder}/rows", schema_of(transitions.CHANGE_SCHEMA))
    carried = LoggedTable(f"{folder}/carried", schema_of(transitions.CHANGE_SCHEMA), newest_of(["cluster_id"]))

    def step(batch: DataFrame, batch_id: int) -> None:
        changes = staged(batch, folder, batch_id)
        before = touched(carried.before(batch.sparkSession, batch_id), changes, ["cluster_id"])
        kept = staged(transitions.believed_changes(changes, before), f"{folder}/kept", batch_id)
        rows.write(kept, batch_id)
        carried.write(transitions.last_believed(before, kept), batch_id)

    return start_batches(status, step, folder, every=every), rows


class RestartBudget:
    """The budgets of a running monitor, at the newest check of any process."""

    def __init__(self, folder: str, retry_s: int):
        self.known = LoggedTable(f"{folder}/known", schema_of(restarts.KNOWN_SCHEMA), newest_of(restarts.KEY))
        self.downs = LoggedTable(f"{folder}/downs", schema_of(restarts.DOWN_SCHEMA))
        self.clock = _clock_table(folder)
        self.retry_s = retry_s

    def now(self, spark: SparkSession) -> DataFrame:
        return restarts.budget(self.known.now(spark), self.downs.now(spark), self.clock.now(spark).scalar(), self.retry_s)


def start_restart_budget(
    checks: DataFrame, folder: str, max_retry: int, retry_s: int, every: str | None = None
) -> tuple[StreamingQuery, RestartBudget]:
    """Restarts used and given-up time of each process, kept up to date.

    A restart is counted when the clock has passed its due time, also for a
    process that is not checked any more: due times are compared with the clock
    when budgets are read. A batch writes the processes it checks and the times
    it found them down; when parts are merged, what has happened for good
    becomes one row per process.
    """
    state = RestartBudget(folder, retry_s)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = staged(batch.select(*restarts.KEY, "ts", "seq", "alive"), folder, batch_id)
        before = touched(state.known.before(spark, batch_id), arrived, restarts.KEY)
        downs = staged(restarts.down_checks(arrived), f"{folder}/found", batch_id)
        state.clock.write(arrived.agg(F.max("ts").alias("clock")).union(state.clock.before(spark, batch_id)).agg(F.max("clock").alias("clock")), batch_id)
        state.known.write(restarts.known_processes(arrived, downs, before, max_retry, retry_s), batch_id)

        def present(rows: DataFrame) -> DataFrame:
            return restarts.settled(rows, state.known.now(spark), state.clock.now(spark).scalar(), retry_s)

        state.downs.write(downs, batch_id, present)

    return start_batches(checks, step, folder, every=every), state


TOPIC_LOG = (
    "topic string, partition_id int, log_offset bigint, ts_ms bigint, msg_key string, message string, size bigint"
)


def start_tail(topic_log: DataFrame, folder: str, n: int = 50, every: str | None = None) -> tuple[StreamingQuery, LoggedTable]:
    """The records of the last ``n`` offsets of each partition, ready for a latest peek.

    A batch writes its own last records; which of them still count is seen when they are read or merged.
    """
    tail = LoggedTable(f"{folder}/tail", schema_of(TOPIC_LOG), lambda rows: latest_window(rows, n))

    def step(batch: DataFrame, batch_id: int) -> None:
        tail.write(latest_window(batch, n), batch_id)

    return start_batches(topic_log, step, folder, every=every), tail
