"""Streams read in several batches against the same rows at once."""

from datetime import datetime, timedelta

import pytest

from gridsight.operators import kafka, registry, spans
from gridsight.sources.topics import stream_files
from gridsight.streaming import restarts, rollups, running, sessions, transitions, views

START = datetime(2024, 1, 1)
LEFTOVERS = {("starting", "new"), ("starting", "terminated"), ("terminating", "running")}
STATES = ["running", "starting", "new", "terminating", "terminated", "downloading"]
STATUS = "cluster_id bigint, ts timestamp_ntz, seq bigint, status string"


def noise(n, seed=7):
    """Repeatable numbers without a pattern the operators could lean on."""
    value = seed
    for _ in range(n):
        value = (value * 1103515245 + 12345) % 2**31
        yield value >> 8


@pytest.fixture
def status_rows():
    rows, at = [], START
    for seq, value in enumerate(noise(900)):
        at += timedelta(seconds=value % 90)
        rows.append((value % 4, at, seq, STATES[(value // 7) % len(STATES)]))
    return rows


def stream_of(spark, tmp_path, rows, schema, batches=3):
    """The rows as a stream of files, one file per batch in order."""
    size = -(-len(rows) // batches)
    df = None
    for number in range(batches):
        df = spark.createDataFrame(rows[number * size:(number + 1) * size], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return stream_files(spark, df.schema, str(tmp_path / "in"), files_per_trigger=1)


def believed(rows):
    """The rule read row by row."""
    state, kept = {}, []
    for cluster, ts, seq, status in sorted(rows, key=lambda row: (row[1], row[2])):
        if (state.get(cluster), status) in LEFTOVERS:
            continue
        state[cluster] = status
        kept.append((cluster, ts, seq, status))
    return sorted(kept, key=repr)


@pytest.mark.parametrize("span_s", [1, 60, 3600, 10**6, 10**9])
def test_believed_changes_follow_the_rule(spark, rows, status_rows, span_s):
    changes = spark.createDataFrame(status_rows, STATUS)
    assert rows(transitions.believed_changes(changes, None, span_s)) == believed(status_rows)


@pytest.mark.parametrize("span_s", [10, 3600, 10**9])
def test_believed_changes_go_on_from_a_carried_state(spark, rows, status_rows, span_s):
    first, second = status_rows[:400], status_rows[400:]
    kept = transitions.believed_changes(spark.createDataFrame(first, STATUS))
    carried = transitions.last_believed(spark.createDataFrame([], STATUS), kept)
    rest = transitions.believed_changes(spark.createDataFrame(second, STATUS), carried, span_s)
    assert rows(kept.union(rest)) == believed(status_rows)


def test_believed_stream(spark, tmp_path, rows, status_rows):
    folder = str(tmp_path / "work")
    stream = stream_of(spark, tmp_path, status_rows, STATUS, 4)
    query, table = views.start_believed(stream, folder)
    query.awaitTermination()
    assert rows(table.now(spark)) == believed(status_rows)


def test_believed_stream_of_many_batches_has_few_parts(spark, tmp_path, rows, status_rows, monkeypatch):
    monkeypatch.setattr(running.LoggedTable, "FAN", 2)
    query, table = views.start_believed(stream_of(spark, tmp_path, status_rows[:400], STATUS, 6), str(tmp_path / "w"))
    query.awaitTermination()
    assert rows(table.now(spark)) == believed(status_rows[:400])
    newest = table._parts(spark, table._lists(spark)[-1])
    assert len(newest) == 2  # 4 + 2 batches
    # parts of the kept lists and nothing else
    assert len(list((tmp_path / "w" / "rows" / "parts").iterdir())) <= len(newest) + running.LoggedTable.FAN + running.LoggedTable.KEPT


def test_latest_state_in_batches(spark, tmp_path, rows, status_rows):
    query, table = views.start_keyed(views.latest_state(stream_of(spark, tmp_path, status_rows, STATUS)), str(tmp_path / "w"), views.LATEST_STATE)
    query.awaitTermination()
    newest = {}
    for cluster, ts, seq, status in status_rows:
        newest[cluster] = (cluster, ts, status)
    assert table._lists(spark)[-1] >= 2
    assert rows(table.now(spark)) == sorted(newest.values(), key=repr)


def test_a_stream_carries_on_from_its_checkpoint(spark, tmp_path, rows, status_rows):
    folder, half = str(tmp_path / "w"), len(status_rows) // 2
    for part in (status_rows[:half], status_rows[half:]):
        stream = stream_of(spark, tmp_path, part, STATUS, 1)
        query, table = views.start_keyed(views.latest_state(stream), folder, views.LATEST_STATE)
        query.awaitTermination()
    newest = {cluster: (cluster, ts, status) for cluster, ts, seq, status in status_rows}
    assert rows(table.now(spark)) == sorted(newest.values(), key=repr)


KEYED = "cluster_id bigint, status string"


def keyed_table(tmp_path):
    return running.LoggedTable(str(tmp_path / "table"), views.schema_of(KEYED), running.newest_of(["cluster_id"]))


def test_a_table_is_found_again_after_a_restart(spark, tmp_path, rows):
    table = keyed_table(tmp_path)
    assert table.now(spark).count() == 0
    for batch_id in range(6):
        table.write(spark.createDataFrame([(batch_id % 2, f"state {batch_id}")], KEYED), batch_id)
    again = keyed_table(tmp_path)
    assert rows(again.now(spark)) == [(0, "state 4"), (1, "state 5")]
    assert again._lists(spark) == [2, 3, 4, 5]
    (tmp_path / "table" / "lists" / "5.list").unlink()  # as if the last batch had not been finished
    assert rows(keyed_table(tmp_path).now(spark)) == [(0, "state 4"), (1, "state 3")]


def test_a_reader_follows_the_writer(spark, tmp_path, rows):
    writer, reader = keyed_table(tmp_path), keyed_table(tmp_path)
    for batch_id in range(9):
        writer.write(spark.createDataFrame([(batch_id, "new")], KEYED), batch_id)
        assert rows(reader.now(spark)) == sorted([(n, "new") for n in range(batch_id + 1)], key=repr)


def test_a_slow_reader_keeps_its_parts(spark, tmp_path, rows):
    table = keyed_table(tmp_path)
    for batch_id in range(7):
        table.write(spark.createDataFrame([(batch_id, "new")], KEYED), batch_id)
    held = table.now(spark)
    table.write(spark.createDataFrame([(7, "new")], KEYED), 7)  # merges all parts
    assert len(table._parts(spark, 7)) == 1
    table.write(spark.createDataFrame([(8, "new")], KEYED), 8)
    assert held.count() == 7


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, rows):
    table = keyed_table(tmp_path)
    for batch_id in range(running.LoggedTable.FAN):
        for _ in range(2):
            table.write(spark.createDataFrame([(batch_id % 3, f"state {batch_id}")], KEYED), batch_id)
    expected = [(0, "state 6"), (1, "state 7"), (2, "state 5")]
    assert rows(table.now(spark)) == expected
    assert rows(table.before(spark, 7)) == [(0, "state 6"), (1, "state 4"), (2, "state 5")]
    assert len(list((tmp_path / "table" / "parts").iterdir())) <= running.LoggedTable.FAN + 1


def test_what_a_batch_writes_follows_what_it_changed(spark, tmp_path, rows):
    table = keyed_table(tmp_path)
    table.write(spark.range(200_000).selectExpr("id AS cluster_id", "sha2(string(id), 256) AS status"), 0)

    def sizes():
        return {part: sum(file.stat().st_size for file in part.iterdir()) for part in (tmp_path / "table" / "parts").iterdir()}

    first = sizes()
    for batch_id in range(1, 7):
        table.write(spark.createDataFrame([(batch_id, "new")], KEYED), batch_id)
    assert sum(size for part, size in sizes().items() if part not in first) < sum(first.values()) / 100
    assert table.now(spark).count() == 200_000 and table.now(spark).where("status = 'new'").count() == 6


def test_null_keys_are_one_row(spark, tmp_path, rows):
    table = keyed_table(tmp_path)
    for batch_id, status in enumerate(["a", "b"]):
        table.write(spark.createDataFrame([(None, status)], KEYED), batch_id)
    assert rows(table.now(spark)) == [(None, "b")]
    assert rows(running.touched(table.now(spark), spark.createDataFrame([(None, "x")], KEYED), ["cluster_id"])) == [(None, "b")]


def test_a_live_stream_keeps_refreshing(spark, tmp_path, rows, status_rows):
    stream = stream_of(spark, tmp_path, status_rows, STATUS, 2)
    query, table = views.start_keyed(views.latest_state(stream), str(tmp_path / "w"), views.LATEST_STATE, views.REFRESH_EVERY)
    try:
        query.processAllAvailable()
        assert query.isActive and table.now(spark).count() == 4
    finally:
        query.stop()


def idle(spark, tmp_path, data, batches, **options):
    query, table = views.start_idle(stream_of(spark, tmp_path, data, STATUS, batches), str(tmp_path / "w"), **options)
    query.awaitTermination()
    return table.now(spark)


def test_idle_gap_is_longer_than_the_timeout(spark, tmp_path, rows):
    seconds = [0, 119, 239, 360, 361, 1000]
    data = [(1, START + timedelta(seconds=second), number, "running") for number, second in enumerate(seconds)]
    found = rows(idle(spark, tmp_path, data, 1), "active_from", "last_heartbeat", "idle_from", "heartbeats")
    at = lambda second: START + timedelta(seconds=second)
    assert found == [(at(0), at(239), at(359), 3), (at(360), at(361), at(481), 2)]


def silences(data, gap):
    """Spells read heartbeat by heartbeat; those over at the newest one."""
    clock, found = max(row[1] for row in data), []
    for cluster in {row[0] for row in data}:
        spell = None
        for _, ts, _, _ in sorted((row for row in data if row[0] == cluster), key=lambda row: row[1]):
            if spell and ts - spell[1] <= gap:
                spell = [spell[0], ts, spell[2] + 1]
            else:
                found += [(cluster, *spell)] if spell else []
                spell = [ts, ts, 1]
        found.append((cluster, *spell))
    return sorted([(c, a, last, last + gap, n) for c, a, last, n in found if last + gap <= clock], key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_idle_in_batches(spark, tmp_path, rows, batches):
    data, at = [], START
    for seq, value in enumerate(noise(700, 5)):
        at += timedelta(milliseconds=value % 60_000)
        # a third of the heartbeats are one cluster's, and one cluster has no name
        data.append((1 if value % 3 == 0 else None if value % 31 == 1 else value % 9, at, seq, "running"))
    found = rows(idle(spark, tmp_path, data, batches, gap_s=90))
    assert found == silences(data, timedelta(seconds=90))


def test_heartbeats_that_can_only_belong_to_an_old_spell_are_late(spark, tmp_path, rows):
    at = lambda second: START + timedelta(seconds=second)
    data = [(1, at(0), 1, "a"), (2, at(500), 2, "a"), (1, at(10), 3, "a"), (1, at(450), 4, "a"), (3, at(900), 5, "a"), (None, None, 6, "a")]
    found = rows(idle(spark, tmp_path, data, 3, gap_s=100), "cluster_id", "active_from", "heartbeats")
    assert found == [(1, at(0), 1), (1, at(450), 1), (2, at(500), 1)]


def test_an_idle_batch_combines_a_hot_cluster_before_it_moves(spark):
    status = spark.range(100_000).selectExpr(
        "1L AS cluster_id", "timestamp_millis(id)::timestamp_ntz AS ts", "id AS seq", "'running' AS status"
    )
    assert sessions.windows(status, 10).count() == 10
    assert sessions.spells(sessions.windows(status, 10), 10).collect()[0]["heartbeats"] == 100_000


@pytest.mark.parametrize("batches", [1, 4])
def test_rollup_follows_each_change(spark, tmp_path, rows, batches):
    schema = "cluster_id bigint, name string, ts timestamp_ntz, seq bigint, status string"
    data = []
    for seq, value in enumerate(noise(300, 3)):
        status = ["running", "stopped", "new"][min(value // 5 % 5 // 2, 2)]
        data.append((value % 9, f"p{value // 11 % 3}", START + timedelta(seconds=seq // 2), seq, status))
    query, table = views.start_rollup(stream_of(spark, tmp_path, data, schema, batches), str(tmp_path / "w"))
    query.awaitTermination()
    expected, processes = {}, {}
    for cluster, name, _, _, status in data:
        processes[(cluster, name)] = status
        states = {state for key, state in processes.items() if key[0] == cluster}
        agreed = {"running": "running", "stopped": "terminated"}.get(status) if len(states) == 1 else None
        expected[cluster] = agreed or expected.get(cluster, "unknown")
    assert rows(table.now(spark)) == sorted(expected.items(), key=repr)


def test_rollup_passes_over_late_changes(spark, tmp_path, rows):
    schema = "cluster_id bigint, name string, ts timestamp_ntz, seq bigint, status string"
    at = lambda minutes: START + timedelta(minutes=minutes)
    data = [(1, "a", at(5), 1, "running"), (None, "a", at(5), 2, "stopped"), (1, "a", at(3), 3, "stopped"), (None, None, at(6), 4, "running")]
    query, table = views.start_rollup(stream_of(spark, tmp_path, data, schema, 2), str(tmp_path / "w"))
    query.awaitTermination()
    assert rows(table.now(spark)) == sorted([(1, "running"), (None, "terminated")], key=repr)


@pytest.mark.parametrize("span_s", [1, 7, 60, 10**6])
def test_rollup_is_the_same_for_every_span(spark, rows, span_s):
    changes = "cluster_id bigint, name string, ts timestamp_ntz, seq bigint, status string"
    data = [
        (value % 2, f"p{value // 3 % 3}", START + timedelta(seconds=seq // 3), seq, ["running", "stopped"][value // 31 % 2])
        for seq, value in enumerate(noise(400, 23))
    ]
    before = spark.createDataFrame([(1, "p0", START - timedelta(days=1), 0, "stopped")], views.PROCESS_STATE)
    df = spark.createDataFrame(data, changes)
    expected, processes = {}, {(1, "p0"): "stopped"}
    for cluster, name, _, _, status in data:
        moved = processes.get((cluster, name)) != status
        processes[(cluster, name)] = status
        states = {state for key, state in processes.items() if key[0] == cluster}
        if moved and len(states) == 1:
            expected[cluster] = {"running": "running", "stopped": "terminated"}[status]
    assert rows(rollups.last_agreed(before, df, span_s).where("status IS NOT NULL")) == sorted(expected.items(), key=repr)


def test_sums_of_a_hot_key_are_split_over_spans(spark, rows):
    """A key with all rows: no task of the inner window has more than a span."""
    df = spark.range(5000).selectExpr("1L AS k", "timestamp_seconds(id)::timestamp_ntz AS ts", "id AS seq", "1L AS one")
    found = spans.with_running_sums(df, ["k"], ["ts", "seq"], ["one"], 100)
    assert found.where("one <> seq + 1").count() == 0
    earlier = spans.with_earlier(df, ["k"], ["ts", "seq"], "seq", "was", 100)
    assert earlier.where("coalesce(was.seq, -1) <> seq - 1").count() == 0


def monitor(checks, max_retry, retry_s):
    """The monitor played through second by second of its checks; restarts happen by themselves until the newest check of any process."""
    result, clock = {}, max(row[2] for row in checks)
    for key in {(row[0], row[1]) for row in checks}:
        due, over, status, last = [], None, None, None
        for _, _, ts, _, alive in sorted((row for row in checks if (row[0], row[1]) == key), key=lambda row: row[2:4]):
            status, last = ("running" if alive else "stopped"), ts
            if alive:
                continue
            if sum(when <= ts for when in due) >= max_retry:
                over = ts
                break
            due.append(ts + timedelta(seconds=retry_s))
        result[key] = (*key, status, last, sum(when <= (over or clock) for when in due), over)
    return sorted(result.values(), key=repr)


def test_a_restart_needs_no_later_check(spark, tmp_path, rows):
    at = lambda second: START + timedelta(seconds=second)
    data = [(1, "a", at(0), 0, False), (2, "b", at(5), 1, True), (2, "b", at(9), 2, True), (2, "b", at(10), 3, True)]
    for retry_s, used in ((10, 1), (11, 0)):
        query, table = views.start_restart_budget(stream_of(spark, tmp_path / str(retry_s), data, CHECKS, 4), str(tmp_path / f"w{retry_s}"), 3, retry_s)
        query.awaitTermination()
        assert rows(table.now(spark), "cluster_id", "restarts_used") == [(1, used), (2, 0)]


def test_settled_checks_become_one_row(spark, tmp_path, rows, checks, monkeypatch):
    monkeypatch.setattr(running.LoggedTable, "FAN", 2)
    query, table = views.start_restart_budget(stream_of(spark, tmp_path, checks, CHECKS, 4), str(tmp_path / "w"), 1000, 30)
    query.awaitTermination()
    assert rows(table.now(spark)) == monitor(checks, 1000, 30)
    assert table.downs.now(spark).count() < sum(not row[4] for row in checks) / 2


@pytest.fixture
def checks():
    data, at = [], START
    for seq, value in enumerate(noise(600, 11)):
        at += timedelta(seconds=1 + value % 5)
        data.append((value % 3, f"p{value // 13 % 2}", at, seq, value // 3 % 4 != 0))
    return data


CHECKS = "cluster_id bigint, process string, ts timestamp_ntz, seq bigint, alive boolean"


@pytest.mark.parametrize("max_retry, retry_s", [(0, 10), (1, 10), (5, 30), (8, 120), (1000, 10)])
def test_restart_budget(spark, rows, checks, max_retry, retry_s):
    df = spark.createDataFrame(checks, CHECKS)
    assert rows(restarts.restart_budget(df, max_retry, retry_s)) == monitor(checks, max_retry, retry_s)


@pytest.mark.parametrize("max_retry, retry_s", [(5, 30), (12, 200)])
def test_restart_budget_in_batches(spark, tmp_path, rows, checks, max_retry, retry_s):
    stream = stream_of(spark, tmp_path, checks, CHECKS, 5)
    query, table = views.start_restart_budget(stream, str(tmp_path / "w"), max_retry, retry_s)
    query.awaitTermination()
    assert rows(table.now(spark)) == monitor(checks, max_retry, retry_s)


def test_tail_in_batches(spark, tmp_path, rows):
    data = [("t", value % 3, seq, 1000 + seq, "k", "m", 1) for seq, value in enumerate(noise(400))]
    query, table = views.start_tail(stream_of(spark, tmp_path, data, views.TOPIC_LOG), str(tmp_path / "w"), 40)
    query.awaitTermination()
    whole = spark.createDataFrame(data, views.TOPIC_LOG)
    assert rows(kafka.peek_latest(table.now(spark), 40)) == rows(kafka.peek_latest(whole, 40))


def test_late_samples_are_dropped(spark, tmp_path, rows):
    """A row is late when its window had closed by the batch before."""
    schema = "ts timestamp_ntz, region string, used bigint"
    at = lambda minutes: START + timedelta(minutes=minutes)
    data = [(at(1), "eden", 5), (at(70), "eden", 7), (at(80), "eden", 1), (at(90), "eden", 1), (at(2), "eden", 100), (at(200), "eden", 1)]
    stream = views.metric_windows(stream_of(spark, tmp_path, data, schema, 3), "1 hour")
    running.start_append(stream, str(tmp_path / "w")).awaitTermination()
    found = rows(running.appended(spark, str(tmp_path / "w"), stream.schema), "window_start", "samples", "total_used")
    assert found == [(at(0), 1, 5), (at(60), 3, 9)]


def test_alerts_fire_once_per_window(spark, tmp_path, rows):
    schema = "job_id bigint, launch_ms bigint, duration_ms bigint, gc_ms bigint, state string"
    data = [(1, 1000, 500, 0, "completed"), (1, 2000, 900, 0, "completed"), (1, 61000, 100, 0, "failed"), (1, 300000, 1, 0, "completed")]
    rules = spark.createDataFrame(
        [(1, 1, "maxTaskRuntime", "exceeds", 400, "ms"), (2, 1, "appFinalStatus", "equals", 0, "boolean")],
        "alert_id bigint, job_id bigint, metric string, operator string, value int, unit string",
    )
    stream = views.alert_stream(stream_of(spark, tmp_path, data, schema, 2), rules, "1 minute")
    running.start_append(stream, str(tmp_path / "w")).awaitTermination()
    fired = rows(running.appended(spark, str(tmp_path / "w"), stream.schema), "window_start", "alert_id", "measured")
    assert fired == [(datetime(1970, 1, 1), 1, 900), (datetime(1970, 1, 1, 0, 1), 2, 0)]


def test_progress_keeps_the_newest_usable_detail(spark, tmp_path, rows):
    schema = "cluster_id bigint, ts timestamp_ntz, seq bigint, status_detail string"
    data = [(1, START, 1, "1024/2048"), (1, START, 2, "2048/2048"), (1, START, 3, ""), (2, START, 4, "0/10")]
    query, table = views.start_keyed(views.progress_stream(stream_of(spark, tmp_path, data, schema, 2)), str(tmp_path / "w"), views.PROGRESS)
    query.awaitTermination()
    assert rows(table.now(spark), "cluster_id", "done", "percent", "done_text") == [(1, 2048, 100, "2.0 KB")]


def test_rollup_equals_the_batch_operator(spark, tmp_path, rows):
    schema = "cluster_id bigint, name string, ts timestamp_ntz, seq bigint, status string"
    data = [(c, f"p{p}", START, c * 10 + p, "running" if c % 2 else "stopped") for c in range(6) for p in range(3)]
    query, table = views.start_rollup(stream_of(spark, tmp_path, data, schema, 1), str(tmp_path / "w"))
    query.awaitTermination()
    clusters = spark.createDataFrame([(c, "unknown") for c in range(6)], "id bigint, status string")
    batch = registry.rollup_status(clusters, spark.createDataFrame(data, schema))
    assert rows(table.now(spark)) == rows(batch, "cluster_id", "status")
