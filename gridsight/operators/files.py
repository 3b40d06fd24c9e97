"""File listings of object stores and HDFS.

``files`` has one row per entry: name, size, last_modified (epoch seconds), owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bytes_to_decimal_size, bytes_to_size

ENTRY = ["name", "is_directory", "size", "last_modified", "owner"]


def list_root(files: DataFrame) -> DataFrame:
    """top-level directories once each, and the files directly below the root."""
    nested = F.contains(F.col("name"), F.lit("/"))
    directories = (
        files.filter(nested)
        .select(F.concat(F.split_part("name", F.lit("/"), F.lit(1)), F.lit("/")).alias("name"))
        .distinct()
        .select(
            "name",
            F.lit(True).alias("is_directory"),
            F.lit(0).cast("bigint").alias("size"),
            F.lit(0).cast("bigint").alias("last_modified"),
            F.lit(None).cast("string").alias("owner"),
        )
    )
    return directories.unionByName(files.filter(~nested).withColumn("is_directory", F.lit(False)).select(*ENTRY))


def list_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """every entry below a prefix, at any depth."""
    return (
        files.filter(F.startswith(F.col("name"), F.lit(prefix)))
        .withColumn("is_directory", F.endswith(F.col("name"), F.lit("/")))
        .select(*ENTRY)
    )


def list_page(files: DataFrame, marker: str | None = None, n: int = 1000) -> DataFrame:
    """the next ``n`` entries in name order after ``marker``.

    ``has_more`` and ``next_marker`` are the same on every row of the page. One
    entry beyond the page is read to know whether more follow; the windows run
    over those ``n + 1`` rows only.
    """
    rest = files if marker is None else files.filter(F.col("name") > marker)
    ahead = rest.orderBy("name").limit(n + 1)
    whole = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = (
        ahead.withColumn("position", F.row_number().over(Window.orderBy("name")))
        .withColumn("has_more", F.count(F.lit(1)).over(whole) > n)
        .withColumn("next_marker", F.max(F.when(F.col("position") == n, F.col("name"))).over(whole))
    )
    return numbered.filter(F.col("position") <= n).select(
        F.col("position").cast("bigint").alias("position"),
        "name",
        F.endswith(F.col("name"), F.lit("/")).alias("is_directory"),
        "size",
        "last_modified",
        "has_more",
        F.when(F.col("has_more"), F.col("next_marker")).alias("next_marker"),
    )


def hdfs_entries(status: DataFrame) -> DataFrame:
    """typed listing of decoded status rows, with display sizes; that of the block is decimal."""
    is_directory = F.col("type") == "DIRECTORY"
    return status.select(
        "directory",
        F.col("pathSuffix").alias("name"),
        "type",
        F.col("length").alias("size"),
        F.when(is_directory, F.lit("--")).otherwise(bytes_to_size(F.col("length"))).alias("size_text"),
        "owner",
        F.col("group").alias("owner_group"),
        "permission",
        "replication",
        bytes_to_decimal_size(F.col("blockSize")).alias("block_size"),
        F.when(F.col("accessTime") > 0, F.col("accessTime")).alias("accessed_ms"),
        F.col("modificationTime").alias("modified_ms"),
    )


def with_file_kind(files: DataFrame) -> DataFrame:
    """extension, directory flag and display size of each entry."""
    is_directory = F.endswith(F.col("name"), F.lit("/"))
    return files.select(
        "name",
        is_directory.alias("is_directory"),
        F.nullif(F.regexp_extract("name", r"\.([^./]+)$", 1), F.lit("")).alias("extension"),
        "size",
        F.when(is_directory, F.lit("--")).otherwise(bytes_to_size(F.col("size"))).alias("size_text"),
    )


def size_by_extension(files: DataFrame) -> DataFrame:
    """entries and bytes per extension."""
    return (
        with_file_kind(files)
        .groupBy("extension")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
        .withColumn("size_text", bytes_to_size(F.col("bytes")))
    )
