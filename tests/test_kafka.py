import pytest

from gridsight.operators import kafka

LOG = "topic string, partition_id int, log_offset bigint, ts_ms bigint, msg_key string, message string, size bigint"


@pytest.fixture
def log(spark):
    rows = [("t", 0, offset, 1000 + offset, "k", f"m{offset}", 10) for offset in range(5, 15)]
    rows += [("t", 1, offset, 2000 + offset, "k", f"n{offset}", 10) for offset in range(3)]
    rows += [("T", 0, 0, 1, "k", "other", 10), ("gap", 0, 1, 1, "k", "a", 1), ("gap", 0, 100, 2, "k", "b", 1)]
    return spark.createDataFrame(rows, LOG)


REPLICA = "topic string, partition_id int, broker_id int, leader boolean, in_sync boolean, size bigint"


@pytest.fixture
def replicas(spark):
    return spark.createDataFrame(
        [("t", 0, 1, True, True, 100), ("t", 0, 2, False, False, 90), ("t", 1, 2, True, True, 50), ("T", 0, 1, True, True, 7)],
        REPLICA,
    )


def test_offsets(log, replicas, rows):
    assert rows(kafka.partition_offsets(log, replicas)) == [
        ("T", 0, 0, 1, 1, [1]), ("t", 0, 5, 15, 10, [1, 2]), ("t", 1, 0, 3, 3, [2]),
    ]


def test_summary_has_one_row_per_exact_topic_name(log, replicas, rows):
    result = kafka.topic_summary(replicas, kafka.offset_ranges(log))
    assert rows(result) == [("T", [0], [1], 1, 7, "7 B"), ("t", [0, 1], [1, 2], 13, 240, "240 B")]


def test_broker_stats_and_replica_state(replicas, rows):
    assert rows(kafka.broker_topic_stats(replicas)) == [(1, "T", 1, 7), (1, "t", 1, 100), (2, "t", 2, 140)]
    assert rows(kafka.replica_state(replicas)) == [
        ("T", 0, 1, 1, 1, False), ("t", 0, 1, 1, 2, True), ("t", 1, 2, 1, 1, False),
    ]


def test_peek_beginning_takes_first_of_each_partition_newest_first(log, rows):
    result = kafka.peek_beginning(log, 2).filter("topic = 't'")
    assert rows(result, "position", "partition_id", "log_offset") == [(1, 1, 1), (2, 1, 0)]


def test_peek_latest_reads_short_partitions_from_their_beginning(log, rows):
    result = kafka.peek_latest(log, 4).filter("topic = 't'")
    assert rows(result, "position", "partition_id", "log_offset") == [(1, 1, 2), (2, 1, 1), (3, 1, 0), (4, 0, 14)]


def test_latest_window_counts_offsets_not_records(log, rows):
    assert rows(kafka.latest_window(log, 50).filter("topic = 'gap'"), "log_offset") == [(100,)]
    assert rows(kafka.latest_window(log, 100).filter("topic = 'gap'"), "log_offset") == [(1,), (100,)]


def test_lag(spark, log, rows):
    offsets = kafka.offset_ranges(log)
    assigned = spark.createDataFrame(
        [("g", "c1", "t", 0), ("g", "c2", "t", 1)], "group_id string, member string, topic string, partition_id int"
    )
    done = spark.createDataFrame(
        [("g", "t", 0, 12), ("g", "T", 0, 0)], "group_id string, topic string, partition_id int, committed_offset bigint"
    )
    groups = spark.createDataFrame([("g", 1, "Stable"), ("idle", 2, "Empty")], "group_id string, coordinator int, state string")
    assert rows(kafka.member_lag(assigned, done, offsets), "member", "end_offset", "committed_offset", "lag") == [
        ("c1", 15, 12, 3), ("c2", 3, None, None),
    ]
    assert rows(kafka.group_lag(groups, assigned, done, offsets)) == [("g", 1, "Stable", 3), ("idle", 2, "Empty", 0)]


def test_peek_trims_before_the_shuffle(log):
    plan = kafka.peek_beginning(log, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
