"""Kafka topics as tables and streams.

The Kafka source is a separate package; it is needed only when a reader runs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_ms


def topic_options(servers: str, topics: list[str], starting: str = "earliest") -> dict[str, str]:
    """Source options; ``starting`` is ``earliest``, ``latest`` or a JSON offset map."""
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting}


def shape_records(records: DataFrame) -> DataFrame:
    """Source columns in the shape the operators take."""
    return records.select(
        "topic",
        F.col("partition").alias("partition_id"),
        F.col("offset").alias("log_offset"),
        epoch_ms(F.col("timestamp").cast("timestamp_ntz")).alias("ts_ms"),
        F.col("key").cast("string").alias("msg_key"),
        F.col("value").cast("string").alias("message"),
        (F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)))
        .cast("bigint")
        .alias("size"),
    )


def read_topic(
    spark: SparkSession, servers: str, topics: list[str], starting: str = "earliest", extra: Mapping[str, str] | None = None
) -> DataFrame:
    """Records of topics up to now."""
    options = topic_options(servers, topics, starting) | {"endingOffsets": "latest"} | dict(extra or {})
    return shape_records(spark.read.format("kafka").options(**options).load())


def stream_topic(
    spark: SparkSession, servers: str, topics: list[str], group_id: str, starting: str = "latest", per_trigger: int = 1_000_000
) -> DataFrame:
    """Records of topics as they arrive; progress is kept in the query's checkpoint."""
    options = topic_options(servers, topics, starting)
    options |= {"kafka.group.id": group_id, "maxOffsetsPerTrigger": str(per_trigger)}
    return shape_records(spark.readStream.format("kafka").options(**options).load())


def stream_files(spark: SparkSession, schema, path: str, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder or glob as a stream, for telemetry that lands in storage."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
