"""Kafka and file listing queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import files as files_ops
from ..operators import kafka
from ..sources.files import decode_hdfs_status, read_file_listing
from . import bindings as b
from .binding_sql import bytes_to_decimal_size, bytes_to_size, readable_size
from .catalogue import listed, query


def _offsets(spark, folder):
    return kafka.offset_ranges(b.topic_log(spark, folder))


@query(
    "K1",
    "SELECT topic, partition_id, start_offset, end_offset, messages, replica_ids FROM offsets JOIN (SELECT topic, partition_id, "
    "string_agg(DISTINCT CAST(broker_id AS VARCHAR), ',' ORDER BY CAST(broker_id AS VARCHAR)) AS replica_ids FROM replicas "
    "GROUP BY ALL) USING (topic, partition_id)",
    ["offsets", "replicas"],
)
def partition_offsets(spark, folder):
    result = kafka.partition_offsets(b.topic_log(spark, folder), b.replicas(spark, folder))
    return result.withColumn("replica_ids", listed(F.col("replica_ids")))


@query(
    "K2 X6",
    "SELECT topic, partitions, brokers, CAST(messages AS BIGINT) AS messages, size, "
    f"{readable_size('size')} AS size_text FROM (SELECT topic, string_agg(DISTINCT CAST(partition_id AS VARCHAR), ',' ORDER BY "
    "CAST(partition_id AS VARCHAR)) AS partitions, string_agg(DISTINCT CAST(broker_id AS VARCHAR), ',' ORDER BY "
    "CAST(broker_id AS VARCHAR)) AS brokers, CAST(sum(size) AS BIGINT) AS size FROM replicas GROUP BY topic) "
    "JOIN (SELECT topic, sum(messages) AS messages FROM offsets GROUP BY topic) USING (topic)",
    ["offsets", "replicas"],
)
def topic_summary(spark, folder):
    result = kafka.topic_summary(b.replicas(spark, folder), _offsets(spark, folder))
    return result.withColumn("partitions", listed(F.col("partitions"))).withColumn("brokers", listed(F.col("brokers")))


@query(
    "K3",
    "SELECT broker_id, topic, count(DISTINCT partition_id) AS partitions, CAST(sum(size) AS BIGINT) AS size "
    "FROM replicas GROUP BY broker_id, topic",
    ["replicas"],
)
def broker_topic_stats(spark, folder):
    return kafka.broker_topic_stats(b.replicas(spark, folder))


_PEEK = (
    "SELECT topic, position, partition_id, log_offset, ts_ms, strftime(make_timestamp(ts_ms * 1000), '%d-%m-%Y %H:%M:%S.%g') "
    "AS time_text, msg_key, message FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts_ms DESC, partition_id, "
    "log_offset) AS position FROM ({chosen})) WHERE position <= {n}"
)


@query(
    "K4 X17",
    _PEEK.format(
        chosen="SELECT * FROM topic_log QUALIFY row_number() OVER (PARTITION BY topic, partition_id ORDER BY log_offset) <= 50", n=50
    ),
    ["topic_log"],
)
def peek_beginning(spark, folder):
    return kafka.peek_beginning(b.topic_log(spark, folder), 50)


@query(
    "K5 X17",
    _PEEK.format(
        chosen="SELECT l.* FROM topic_log l JOIN offsets o USING (topic, partition_id) "
        "WHERE log_offset >= greatest(start_offset, end_offset - 800)",
        n=800,
    ),
    ["topic_log", "offsets"],
)
def peek_latest(spark, folder):
    return kafka.peek_latest(b.topic_log(spark, folder), 800)


@query(
    "K6",
    "SELECT 'g' || g AS group_id, CAST(g % 3 AS INTEGER) AS coordinator, CASE WHEN g = 3 THEN 'Empty' ELSE 'Stable' END AS state, "
    "CAST(coalesce(lag, 0) AS BIGINT) AS lag FROM (VALUES (0), (1), (2), (3)) v(g) LEFT JOIN (SELECT group_id, "
    "sum(end_offset - committed_offset) AS lag FROM assignments GROUP BY group_id) a ON a.group_id = 'g' || g",
    ["assignments"],
)
def group_lag(spark, folder):
    offsets = _offsets(spark, folder)
    return kafka.group_lag(
        b.consumer_groups(offsets), b.assignments(offsets).drop("g", "end_offset"), b.committed(offsets), offsets
    )


@query(
    "K7",
    "SELECT group_id, member, topic, partition_id, end_offset, committed_offset, end_offset - committed_offset AS lag FROM assignments",
    ["assignments"],
)
def member_lag(spark, folder):
    offsets = _offsets(spark, folder)
    return kafka.member_lag(b.assignments(offsets).drop("g", "end_offset"), b.committed(offsets), offsets)


@query(
    "K8 X16",
    "SELECT DISTINCT broker_id, 'b' || broker_id AS host, CAST(9092 AS INTEGER) AS port, 'r' || broker_id AS rack FROM replicas",
    ["replicas"],
)
def broker_inventory(spark, folder):
    return kafka.broker_inventory(b.brokers(spark, folder))


@query(
    "K8",
    "SELECT 'main' AS kafka_cluster, string_agg('b' || broker_id || ':9092', ',' ORDER BY broker_id) AS bootstrap "
    "FROM (SELECT DISTINCT broker_id FROM replicas)",
    ["replicas"],
)
def bootstrap_servers(spark, folder):
    return kafka.bootstrap_servers(b.brokers(spark, folder))


@query(
    "K9",
    "SELECT topic, config, value, type, source FROM (SELECT DISTINCT event_type AS topic FROM events), (VALUES "
    + ", ".join(str(setting) for setting in b.TOPIC_SETTINGS)
    + ") v(config, value, type, source)",
)
def topic_config(spark, folder):
    return kafka.topic_config(b.topic_configs(spark, folder))


@query(
    "K10",
    "SELECT topic, partition_id, max(CASE WHEN leader THEN broker_id END) AS leader_broker, count(*) FILTER (in_sync) AS "
    "in_sync_replicas, count(*) AS replicas, count(*) FILTER (in_sync) < count(*) AS under_replicated FROM replicas GROUP BY ALL",
    ["replicas"],
)
def replica_state(spark, folder):
    return kafka.replica_state(b.replicas(spark, folder))


@query(
    "F1",
    "SELECT DISTINCT split_part(name, '/', 1) || '/' AS name, true AS is_directory, CAST(0 AS BIGINT) AS size, "
    "CAST(0 AS BIGINT) AS last_modified, CAST(NULL AS VARCHAR) AS owner FROM files WHERE contains(name, '/') "
    "UNION ALL SELECT name, false, size, last_modified, owner FROM files WHERE NOT contains(name, '/')",
    ["files"],
)
def list_root(spark, folder):
    return files_ops.list_root(b.files(spark, folder))


@query(
    "F2",
    "SELECT name, name LIKE '%/' AS is_directory, size, last_modified, owner FROM files WHERE name LIKE 'src1/%'",
    ["files"],
)
def list_prefix(spark, folder):
    return files_ops.list_prefix(b.files(spark, folder), "src1/")


@query(
    "F3",
    "SELECT position, name, name LIKE '%/' AS is_directory, size, last_modified, more AS has_more, "
    "CASE WHEN more THEN max(name) OVER () END AS next_marker FROM (SELECT *, row_number() OVER (ORDER BY name) AS position, "
    "count(*) OVER () > 100 AS more FROM files WHERE name > 'src1') WHERE position <= 100",
    ["files"],
)
def list_page(spark, folder):
    return files_ops.list_page(b.files(spark, folder), "src1", 100)


@query(
    "F4 S5 X7 X8",
    f"SELECT directory, name, type, size, CASE WHEN type = 'DIRECTORY' THEN '--' ELSE {bytes_to_size('size')} END AS size_text, "
    f"owner, 'supergroup' AS owner_group, '644' AS permission, replication, {bytes_to_decimal_size('block')} AS block_size, "
    "nullif(accessed, 0) AS accessed_ms, modified_ms FROM (SELECT "
    "'/' || source || '/' || lang AS directory, 'part-' || doc_id || '-' || p AS name, CASE p WHEN 0 THEN 'FILE' ELSE 'DIRECTORY' END AS type, "
    "CASE p WHEN 0 THEN n_chars * (doc_id % 1000 + 1) ELSE 0 END AS size, 'owner' || (doc_id % 3) AS owner, doc_id % 3 * 67108864 AS block, "
    "doc_id % 5 * 1000000000000 AS accessed, doc_id + 1700000000000 AS modified_ms, "
    "CAST(CASE p WHEN 0 THEN 3 ELSE 0 END AS INTEGER) AS replication FROM documents, (VALUES (0), (1)) v(p) WHERE p = 0 OR doc_id % 4 <> 0)",
)
def hdfs_entries(spark, folder):
    return files_ops.hdfs_entries(decode_hdfs_status(b.hdfs_answers(spark, folder)))


@query(
    "F5 X7",
    "SELECT name, name LIKE '%/' AS is_directory, nullif(regexp_extract(name, '\\.([^./]+)$', 1), '') AS extension, size, "
    f"CASE WHEN name LIKE '%/' THEN '--' ELSE {bytes_to_size('size')} END AS size_text FROM files",
    ["files"],
)
def file_kinds(spark, folder):
    return files_ops.with_file_kind(b.files(spark, folder))


@query(
    "F5 X7",
    f"SELECT extension, files, bytes, {bytes_to_size('bytes')} AS size_text FROM (SELECT "
    "nullif(regexp_extract(name, '\\.([^./]+)$', 1), '') AS extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes "
    "FROM files GROUP BY 1)",
    ["files"],
)
def size_by_extension(spark, folder):
    return files_ops.size_by_extension(b.files(spark, folder))


_STORED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]


@query(
    "S4 F1 F5",
    " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS name, 'parquet' AS extension, (SELECT count(*) FROM {name}) AS row_count" for name in _STORED
    ),
)
def stored_table_kinds(spark, folder):
    """Tables as they are stored in the folder, with their kind and the rows found in their files."""
    stored = files_ops.list_root(read_file_listing(spark, folder))
    stored = files_ops.with_file_kind(stored.withColumn("name", F.regexp_replace("name", "/$", "")))
    counts = [
        b.table(spark, folder, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(f"{name}.parquet").alias("name"), "row_count")
        for name in _STORED
    ]
    return stored.select("name", "extension").join(reduce(DataFrame.union, counts), "name")
