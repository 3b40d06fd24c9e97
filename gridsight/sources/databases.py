"""Relational and wide-column tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.query import UPDATE_WORDS
from .connections import CassandraConnection, JdbcConnection


@dataclass(frozen=True)
class Partitioning:
    """How to split a JDBC read: a numeric, date or timestamp column and its range.

    Without a range the database is asked for the least and the largest value.
    """

    column: str
    lower: str | int | None = None
    upper: str | int | None = None
    partitions: int = 8

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


def read_jdbc(
    spark: SparkSession,
    connection: JdbcConnection,
    query: str | None = None,
    table: str | None = None,
    partition: Partitioning | None = None,
    fetch_size: int = 10000,
) -> DataFrame:
    """Rows of a table or query; Spark pushes filters, aggregates and limits into it.

    Without ``partition`` one task reads everything, so give one for a large
    table: the name of a column is enough, its range is looked up. A query can
    be split as well: it is read as a derived table. Rows outside the range, or
    without a value, are read all the same.
    """
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    if query is not None and query.lower().strip().split(" ")[0] in UPDATE_WORDS:
        raise ValueError("only queries can be read")
    reader = spark.read.format("jdbc").options(**connection.options()).option("fetchsize", fetch_size)
    if partition is None:
        return (reader.option("query", query) if query else reader.option("dbtable", table)).load()
    source = table if table is not None else f"({query}) source_rows"
    if partition.lower is None or partition.upper is None:
        partition = with_range(spark, connection, source, partition)
        if partition is None:  # nothing to cut a range from
            return reader.option("dbtable", source).load()
    return reader.options(**partition.options()).option("dbtable", source).load()


def with_range(spark: SparkSession, connection: JdbcConnection, source: str, partition: Partitioning) -> Partitioning | None:
    """The split with the range that the column has now; None without a value. The database reduces it to one row."""
    ends = f"SELECT min({partition.column}) AS lowest, max({partition.column}) AS highest FROM {source}"
    lowest, highest = spark.read.format("jdbc").options(**connection.options()).option("query", ends).load().first()
    if lowest is None:
        return None
    if isinstance(highest, (int, Decimal)):
        # whole numbers, and the last part must begin before the largest value
        lowest, highest = math.floor(lowest), math.floor(highest) + 1
    return replace(partition, lower=str(lowest), upper=str(highest))


def write_jdbc(df: DataFrame, connection: JdbcConnection, table: str, mode: str = "append", batch_size: int = 10000) -> int:
    """Writes the rows and returns how many there were, counted on the way.

    A task that is run again after a lost executor appends its rows again, as
    JDBC has no commit over tasks; append to a fresh table where that matters.
    """
    observed = Observation()
    counted = df.observe(observed, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.format("jdbc").options(**connection.options())
    writer.option("dbtable", table).option("batchsize", batch_size).mode(mode).save()
    return observed.get["rows"]


def read_wide_column(spark: SparkSession, connection: CassandraConnection, keyspace: str, table: str) -> DataFrame:
    """S3: a Cassandra table through its Spark connector, which has to be on the class path."""
    reader = spark.read.format("org.apache.spark.sql.cassandra")
    return reader.options(**connection.options(keyspace, table)).load()
