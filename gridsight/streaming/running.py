"""Starting streams, and tables that a stream keeps up to date.

Every stream is started with a checkpoint in the shared folder, so it carries
on after the loss of an executor or of the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

# State outside the heap with small commits, and sessions merged before they are shuffled.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def prepare(spark: SparkSession) -> None:
    """Gives a session the settings the streams count on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def _trigger(every: str | None) -> dict[str, object]:
    return {"availableNow": True} if every is None else {"processingTime": every}


def start_append(stream: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Writes finished rows to ``folder/rows``; without a period it stops when the input is used up."""
    prepare(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**_trigger(every)).start()


def start_batches(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    folder: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Hands each micro-batch to ``step``, which must give the same result when repeated."""
    prepare(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(step).outputMode(mode)
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**_trigger(every)).start()


def appended(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows an append stream has written."""
    return spark.read.schema(schema).parquet(f"{folder}/rows")


class LoggedTable:
    """A table kept as a log of what each micro-batch changed, merged from time to time.

    A batch writes its rows as a part of their own, so what it writes follows what it changed and not the size of the table.
    ``FAN`` parts of one level become one part of the next, reduced by ``present``; a row is thus written again once per
    level, and a table of n batches has fewer than ``FAN`` parts for each of the log n levels. Rows carry the ``batch``
    that wrote them, and ``present`` says which of them stand: the newest of each key, or all.

    A list per batch names the parts that make up the table as this batch left it. It is written last and put in its
    place in one step, so a table is always seen whole; a batch that is run again starts from the list before its own and
    gives the same table. Readers look for the newest list each time. The last ``KEPT`` lists and their parts stay for
    readers that are still at work, everything else in the folder is removed. One stream writes a table at a time.
    """

    FAN, KEPT = 8, 4

    def __init__(self, folder: str, schema: StructType, present: Callable[[DataFrame], DataFrame] | None = None):
        self.folder = folder
        self.schema = schema
        self.stored = StructType([*schema.fields, StructField("batch", LongType())])
        self.present = present or (lambda rows: rows)

    def _store(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, spark: SparkSession, pattern: str) -> list[str]:
        path, store = self._store(spark)
        return [entry.getPath().getName() for entry in store.globStatus(path(f"{self.folder}/{pattern}")) or []]

    def _lists(self, spark: SparkSession) -> list[int]:
        """Batches with a list, in order; a few more than ``KEPT`` at most."""
        return sorted(int(name.removesuffix(".list")) for name in self._names(spark, "lists/*.list"))

    def _parts(self, spark: SparkSession, batch_id: int) -> list[str]:
        path, store = self._store(spark)
        stream = store.open(path(f"{self.folder}/lists/{batch_id}.list"))
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _finish(self, spark: SparkSession, batch_id: int, parts: list[str]) -> None:
        """Puts the list of a batch in its place and removes what no kept list names."""
        path, store = self._store(spark)
        made, place = path(f"{self.folder}/lists/{batch_id}.new"), path(f"{self.folder}/lists/{batch_id}.list")
        stream = store.create(made, True)
        stream.writeBytes("\n".join(parts))
        stream.close()
        store.delete(place, False)
        if not store.rename(made, place):
            raise OSError(f"could not put {place} in its place")
        lists = self._lists(spark)
        for old in lists[: -self.KEPT]:
            store.delete(path(f"{self.folder}/lists/{old}.list"), False)
        named = {part for kept in lists[-self.KEPT :] for part in self._parts(spark, kept)}
        for name in self._names(spark, "parts/*"):
            if name not in named:
                store.delete(path(f"{self.folder}/parts/{name}"), True)

    def _read(self, spark: SparkSession, parts: list[str]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], self.stored)
        return spark.read.schema(self.stored).parquet(*[f"{self.folder}/parts/{part}" for part in parts])

    def _write(self, rows: DataFrame, level: int) -> str:
        part = f"{level}-{uuid.uuid4().hex}"
        rows.select(*[F.col(field.name).cast(field.dataType) for field in self.stored.fields]).write.parquet(f"{self.folder}/parts/{part}")
        return part

    def write(self, rows: DataFrame, batch_id: int, present: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Adds the rows that a batch changed; ``present`` reduces parts when they are merged, the table's own unless given."""
        spark = rows.sparkSession
        parts = self._before(spark, batch_id) + [self._write(rows.withColumn("batch", F.lit(batch_id).cast("bigint")), 0)]
        levels = [int(part.split("-")[0]) for part in parts]
        taken = 0
        while len(levels) >= self.FAN and len(set(levels[-self.FAN :])) == 1:
            taken += self.FAN - (taken > 0)
            levels[-self.FAN :] = [levels[-1] + 1]
        if taken:
            merged = (present or self.present)(self._read(spark, parts[-taken:]))
            parts[-taken:] = [self._write(merged, levels[-1])]
        self._finish(spark, batch_id, parts)

    def _before(self, spark: SparkSession, batch_id: int) -> list[str]:
        earlier = [batch for batch in self._lists(spark) if batch < batch_id]
        return self._parts(spark, earlier[-1]) if earlier else []

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table as the batches before this one left it."""
        return self.present(self._read(spark, self._before(spark, batch_id))).select(*self.schema.names)

    def now(self, spark: SparkSession) -> DataFrame:
        """The table as the newest batch left it, whoever wrote it."""
        lists = self._lists(spark)
        return self.present(self._read(spark, self._parts(spark, lists[-1]) if lists else [])).select(*self.schema.names)


def newest_of(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Of the rows of a logged table those that stand when a row takes the place of earlier ones with its key."""

    def present(rows: DataFrame) -> DataFrame:
        others = [name for name in rows.columns if name not in keys]
        last = F.max_by(F.struct(*others), "batch").alias("last")
        return rows.groupBy(*keys).agg(last).select(*keys, "last.*").select(*rows.columns)

    return present


def staged(rows: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """Writes the incoming rows of a batch and returns the written form, so that reading them twice does not run the stream twice."""
    place = f"{folder}/incoming-{batch_id % 2}"
    rows.write.mode("overwrite").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def touched(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a table whose keys occur among changes; null keys match."""
    names = {key: f"changed_{key}" for key in keys}
    changed = changes.select(*[F.col(key).alias(name) for key, name in names.items()]).distinct()
    return rows.join(changed, reduce(and_, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()]), "left_semi")


def upsert(table: LoggedTable) -> Callable[[DataFrame, int], None]:
    """A batch step that lets incoming rows take the place of rows with the same key."""
    return table.write
