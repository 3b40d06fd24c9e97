"""Kafka topics, partitions and consumer groups.

``topic_log`` has one row per record: topic, partition_id, log_offset, ts_ms,
msg_key, message, size. ``replicas`` has one row per (topic, partition_id,
broker_id) with leader, in_sync and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import parse_host_port
from ..functions.sizes import readable_size
from ..functions.times import message_time

PARTITION = ["topic", "partition_id"]


def offset_ranges(topic_log: DataFrame) -> DataFrame:
    """Start, exclusive end and message count of every partition."""
    return topic_log.groupBy(*PARTITION).agg(
        F.min("log_offset").alias("start_offset"),
        (F.max("log_offset") + 1).alias("end_offset"),
        (F.max("log_offset") + 1 - F.min("log_offset")).alias("messages"),
    )


def partition_offsets(topic_log: DataFrame, replicas: DataFrame) -> DataFrame:
    """K1: offset range of each partition with the brokers that hold it.

    A partition has as many replicas as its replication factor, so the array
    is limited by the number of brokers.
    """
    holders = replicas.groupBy(*PARTITION).agg(F.sort_array(F.collect_set("broker_id")).alias("replica_ids"))
    return offset_ranges(topic_log).join(holders, PARTITION)


def topic_summary(replicas: DataFrame, offsets: DataFrame) -> DataFrame:
    """K2: one row per topic, however many brokers hold it.

    Topic names match exactly, with case. Array lengths are limited by the
    partitions of a topic and the brokers of a cluster.
    """
    stored = replicas.groupBy("topic").agg(
        F.sort_array(F.collect_set("partition_id")).alias("partitions"),
        F.sort_array(F.collect_set("broker_id")).alias("brokers"),
        F.sum("size").alias("size"),
    )
    counted = offsets.groupBy("topic").agg(F.sum("messages").alias("messages"))
    return stored.join(counted, "topic", "left").select(
        "topic",
        "partitions",
        "brokers",
        F.coalesce("messages", F.lit(0).cast("bigint")).alias("messages"),
        "size",
        readable_size(F.col("size")).alias("size_text"),
    )


def broker_topic_stats(replicas: DataFrame) -> DataFrame:
    """K3: partitions and bytes of each topic on each broker."""
    return replicas.groupBy("broker_id", "topic").agg(
        F.count_distinct("partition_id").alias("partitions"), F.sum("size").alias("size")
    )


def _newest_first() -> list[Column]:
    return [F.col("ts_ms").desc(), F.col("partition_id").asc(), F.col("log_offset").asc()]


def _cap(records: DataFrame, n: int) -> DataFrame:
    ranked = records.withColumn("position", F.row_number().over(Window.partitionBy("topic").orderBy(*_newest_first())))
    return ranked.filter(F.col("position") <= n).select(
        "topic",
        F.col("position").cast("bigint").alias("position"),
        "partition_id",
        "log_offset",
        "ts_ms",
        message_time(F.col("ts_ms")).alias("time_text"),
        "msg_key",
        "message",
    )


def peek_beginning(topic_log: DataFrame, n: int = 50) -> DataFrame:
    """K4: the first ``n`` records of each partition, at most ``n`` per topic, newest first.

    The rank filter is applied before the shuffle too, so a hot partition
    sends ``n`` rows per task and no more.
    """
    first = Window.partitionBy(*PARTITION).orderBy("log_offset")
    chosen = topic_log.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    return _cap(chosen, n)


def latest_window(topic_log: DataFrame, n: int) -> DataFrame:
    """Records with an offset in the last ``n`` offsets of their partition.

    At most ``n`` records qualify, and they are the newest ones, so the rank
    filter runs first and the end offset is read off the ranked rows.
    """
    newest = Window.partitionBy(*PARTITION).orderBy(F.col("log_offset").desc())
    return (
        topic_log.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= n)
        .withColumn("end_offset", F.first("log_offset").over(newest) + 1)
        .filter(F.col("log_offset") >= F.col("end_offset") - n)
        .drop("rank", "end_offset")
    )


def peek_latest(topic_log: DataFrame, n: int = 50) -> DataFrame:
    """K5: records of the last ``n`` offsets of each partition, at most ``n`` per topic, newest first.

    A partition shorter than ``n`` is read from its beginning.
    """
    return _cap(latest_window(topic_log, n), n)


def member_lag(assignments: DataFrame, committed: DataFrame, offsets: DataFrame) -> DataFrame:
    """K7: log end, committed offset and lag of each assigned partition.

    A partition without a committed offset stays, with null lag.
    """
    return (
        assignments.join(offsets.select(*PARTITION, "end_offset"), PARTITION)
        .join(committed, ["group_id", *PARTITION], "left")
        .select(
            "group_id",
            "member",
            *PARTITION,
            "end_offset",
            "committed_offset",
            (F.col("end_offset") - F.col("committed_offset")).alias("lag"),
        )
    )


def group_lag(groups: DataFrame, assignments: DataFrame, committed: DataFrame, offsets: DataFrame) -> DataFrame:
    """K6: coordinator, state and total lag of each group.

    Only partitions assigned to live members count; those without a committed
    offset are skipped; a group without members has lag 0.
    """
    totals = member_lag(assignments, committed, offsets).groupBy("group_id").agg(F.sum("lag").alias("lag"))
    return groups.join(totals, "group_id", "left").select(
        "group_id", "coordinator", "state", F.coalesce("lag", F.lit(0).cast("bigint")).alias("lag")
    )


def broker_inventory(brokers: DataFrame) -> DataFrame:
    """K8: id, host, port and rack of each broker; ``address`` is ``host:port``."""
    endpoint = parse_host_port(F.col("address"))
    return brokers.select(
        "broker_id", endpoint["host"].alias("host"), endpoint["port"].alias("port"), "rack"
    )


def bootstrap_servers(brokers: DataFrame) -> DataFrame:
    """K8: the broker addresses of each Kafka cluster as one connection string."""
    addresses = F.sort_array(F.collect_list(F.struct("broker_id", "address")))
    return (
        brokers.groupBy("kafka_cluster")
        .agg(addresses.alias("addresses"))
        .select("kafka_cluster", F.array_join(F.col("addresses.address"), ",").alias("bootstrap"))
    )


def topic_config(configs: DataFrame) -> DataFrame:
    """K9: settings of each topic with their type and source."""
    return configs.select("topic", "config", "value", "type", "source")


def replica_state(replicas: DataFrame) -> DataFrame:
    """Leader, in-sync count and under-replicated flag of each partition.

    Formulas are ours: a partition is under-replicated when fewer replicas are
    in sync than exist.
    """
    return replicas.groupBy(*PARTITION).agg(
        F.max(F.when(F.col("leader"), F.col("broker_id"))).alias("leader_broker"),
        F.count_if("in_sync").alias("in_sync_replicas"),
        F.count(F.lit(1)).alias("replicas"),
        (F.count_if("in_sync") < F.count(F.lit(1))).alias("under_replicated"),
    )
