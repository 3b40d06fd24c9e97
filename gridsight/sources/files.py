"""Files: listings, pages, logs and JSON documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .listing import PREFIXES, FolderListing

FILE_STATUS = T.StructType(
    [
        T.StructField("accessTime", T.LongType()),
        T.StructField("blockSize", T.LongType()),
        T.StructField("group", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modificationTime", T.LongType()),
        T.StructField("owner", T.StringType()),
        T.StructField("pathSuffix", T.StringType()),
        T.StructField("permission", T.StringType()),
        T.StructField("replication", T.IntegerType()),
        T.StructField("type", T.StringType()),
    ]
)
STATUS_ANSWER = T.StructType(
    [
        T.StructField("FileStatuses", T.StructType([T.StructField("FileStatus", T.ArrayType(FILE_STATUS))])),
        T.StructField("FileStatus", FILE_STATUS),
    ]
)
ATTEMPT = T.StructType(
    [
        T.StructField("attemptId", T.StringType()),
        T.StructField("startTimeEpoch", T.LongType()),
        T.StructField("endTimeEpoch", T.LongType()),
        T.StructField("completed", T.BooleanType()),
        T.StructField("duration", T.LongType()),
        T.StructField("sparkUser", T.StringType()),
    ]
)
APPLICATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("attempts", T.ArrayType(ATTEMPT)),
    ]
)
YARN_METRICS = T.StructType(
    [
        T.StructField(
            "clusterMetrics",
            T.StructType(
                [
                    T.StructField("appsCompleted", T.LongType()),
                    T.StructField("appsRunning", T.LongType()),
                    T.StructField("appsPending", T.LongType()),
                    T.StructField("appsKilled", T.LongType()),
                ]
            ),
        )
    ]
)
YARN_NODES = T.StructType(
    [
        T.StructField(
            "nodes",
            T.StructType(
                [
                    T.StructField(
                        "node",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("id", T.StringType()),
                                    T.StructField("usedMemoryMB", T.LongType()),
                                    T.StructField("availMemoryMB", T.LongType()),
                                    T.StructField("usedVirtualCores", T.LongType()),
                                    T.StructField("availableVirtualCores", T.LongType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of its store, as listings spell it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def read_file_listing(
    spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, prefixes: int = PREFIXES
) -> DataFrame:
    """Name, is_directory, size, modification time and owner of the files and folders below a path, which is a folder.

    Names are relative to the path, those of folders end with a slash; empty
    folders show too. ``glob`` picks files by their own name. Folders are listed
    in tasks: the driver only looks for about ``prefixes`` folders to hand out.
    No file is opened. Stores list no owner here.
    """
    spark.dataSource.register(FolderListing)
    reader = spark.read.format(FolderListing.name()).option("recursive", str(recursive).lower()).option("prefixes", prefixes)
    if glob is not None:
        reader = reader.option("glob", glob)
    return reader.load(qualified(spark, path))


def decode_hdfs_status(answers: DataFrame, column: str = "json") -> DataFrame:
    """Status answers as rows, from listings and from single files alike."""
    decoded = F.from_json(column, STATUS_ANSWER)
    entries = F.coalesce(decoded["FileStatuses"]["FileStatus"], F.array(decoded["FileStatus"]))
    keys = [name for name in answers.columns if name != column]
    return answers.select(*keys, F.explode(entries).alias("entry")).select(*keys, "entry.*")


def decode_yarn_metrics(answers: DataFrame, column: str = "json") -> DataFrame:
    """Application counts of each YARN cluster."""
    keys = [name for name in answers.columns if name != column]
    decoded = answers.select(*keys, F.from_json(column, YARN_METRICS)["clusterMetrics"].alias("metrics"))
    return decoded.select(
        *keys,
        F.col("metrics.appsCompleted").alias("apps_completed"),
        F.col("metrics.appsRunning").alias("apps_running"),
        F.col("metrics.appsPending").alias("apps_pending"),
        F.col("metrics.appsKilled").alias("apps_killed"),
    )


def decode_yarn_nodes(answers: DataFrame, column: str = "json") -> DataFrame:
    """Memory and cores of each YARN node."""
    keys = [name for name in answers.columns if name != column]
    decoded = answers.select(*keys, F.explode(F.from_json(column, YARN_NODES)["nodes"]["node"]).alias("node"))
    return decoded.select(
        *keys,
        F.col("node.id").alias("node_id"),
        F.col("node.usedMemoryMB").alias("used_memory_mb"),
        F.col("node.availMemoryMB").alias("available_memory_mb"),
        F.col("node.usedVirtualCores").alias("used_cores"),
        F.col("node.availableVirtualCores").alias("available_cores"),
    )


def shape_history(applications: DataFrame) -> DataFrame:
    """History server applications in the shape the operators take."""

    def attempt(entry: Column) -> Column:
        return F.struct(
            entry["attemptId"].alias("attempt_id"),
            entry["startTimeEpoch"].alias("start_ms"),
            entry["endTimeEpoch"].alias("end_ms"),
            entry["completed"].alias("completed"),
            entry["duration"].alias("duration_ms"),
            entry["sparkUser"].alias("spark_user"),
        )

    return applications.select(F.col("id").alias("app_id"), "name", F.transform("attempts", attempt).alias("attempts"))


def read_app_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved history server answers; each file is one JSON array or object."""
    return shape_history(spark.read.schema(APPLICATION).option("multiLine", "true").json(path))


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved status pages, one row per file."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("html"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their offset, ready for L1 to L4.

    An offset is a struct of file and position, the byte at which the line
    begins; it stays the same whatever the size of splits is, and when files are
    added or grow. The bytes of each split are added up first; a line's position
    is what the splits before hold and the lines before in its own. No line
    moves to be numbered. Lines end with a line feed, before which a carriage
    return is dropped.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*split, F.col("value").alias("line"))
    sizes = lines.groupBy("file", "block_start").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "block_start", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    placed = lines.mapInArrow(_with_places, "file string, block_start bigint, place bigint, line string")
    joined = placed.join(bases, ["file", "block_start"])
    offset = F.struct("file", (F.col("base") + F.col("place")).alias("position"))
    return joined.select(offset.alias("log_offset"), F.regexp_replace("line", "\\r$", "").alias("line"))


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes of the lines before in the split; lines come in the order of their split."""
    split, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.add(pc.binary_length(batch["line"]), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        places = np.cumsum(sizes) - sizes
        files, starts = batch["file"], batch["block_start"].to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        fresh = np.concatenate(([True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])))
        first = (files[0].as_py(), int(starts[0]))
        base = np.where(fresh, places, 0)
        places = places - np.maximum.accumulate(base)
        if first == split:  # goes on from the batch before
            places[: np.argmax(fresh[1:]) + 1 if fresh[1:].any() else len(places)] += held
        split, held = (files[-1].as_py(), int(starts[-1])), int(places[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([files, batch["block_start"], pa.array(places), batch["line"]], names=["file", "block_start", "place", "line"])


def write_json_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON objects, one per line, in as many files as there are tasks."""
    rows.write.mode(mode).json(path)
