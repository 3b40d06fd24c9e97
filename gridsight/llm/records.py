"""Token ids as length-delimited binary records with an offset index (operator 4).

A file holds records one after another. A record is

    length    8 bytes   of the payload, little-endian
    check     4 bytes   masked CRC-32 of the eight length bytes
    payload   the ids, little-endian unsigned integers of the width given below
    check     4 bytes   masked CRC-32 of the payload

The mask rotates a checksum right by 15 bits and adds a constant, so that a checksum stored inside data that is
checked again does not cancel out. Ids take two bytes where the vocabulary has at most 65,536 of them, else four.

The index is a Parquet table beside the files: one row per record with its file, byte offset, payload bytes, width,
ids before it in its file and ids in it. A reader takes any rows of it in any order, so shuffled reads need no scan.

Rows are dealt to files by ranges of the key, so files in order of their first key hold ascending keys. Each task
attempt writes a file of its own name, and the index is committed by Spark: a repeated or lost attempt leaves a file
that no index row names. Files lie in the shared folder; a path that is not local is opened through pyarrow's
file systems.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import new_folder
from .encoding import encoder

MASK = 0xA282EAD8
INDEX = "doc_id bigint, file string, shard int, place bigint, offset bigint, bytes bigint, width int, ids_before bigint, n_tokens bigint"
#: Texts encoded together, in characters; bounds a worker's memory whatever the length of a batch.
BATCH_CHARS = 500_000
#: Records handed on together when read.
READ_TOGETHER = 256


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted by a constant."""
    value = zlib.crc32(data)
    return (((value >> 15) | (value << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record around a payload."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of a record; raises if a length or checksum does not fit."""
    (length,) = struct.unpack_from("<Q", record)
    if masked(record[:8]) != struct.unpack_from("<I", record, 8)[0] or len(record) != length + 16:
        raise ValueError("record length is damaged")
    payload = record[12:-4]
    if masked(payload) != struct.unpack_from("<I", record, len(record) - 4)[0]:
        raise ValueError("record payload is damaged")
    return payload


def opened(path: str, mode: str):
    """A file of the shared folder, to write or to read."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        return open(parsed.path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if "w" not in mode:
        return system.open_input_file(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def batches_of(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of at most ``limit`` characters together; a longer text stands alone."""
    start, held = 0, 0
    for place, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > limit:
            yield start, place
            start, held = place, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def _write(folder: str, vocabulary: str, end_id: int | None, width: int):
    end = b"" if end_id is None else struct.pack("<I", end_id)
    kind = "<u2" if width == 2 else "<u4"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        shard = task.partitionId()
        path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.records"
        file, place, offset, ids_before = None, 0, 0, 0
        for frame_in in frames:
            texts = frame_in["text"].tolist()
            for start, stop in batches_of(texts, BATCH_CHARS):
                rows, chunk = [], []
                for doc_id, ids in zip(frame_in["doc_id"][start:stop], encoder(vocabulary).batch(texts[start:stop])):
                    ids += end
                    count = len(ids) // 4
                    record = frame(ids if width == 4 else np.frombuffer(ids, "<u4").astype(kind).tobytes())
                    rows.append((doc_id, path, shard, place, offset, len(record) - 16, width, ids_before, count))
                    chunk.append(record)
                    place, offset, ids_before = place + 1, offset + len(record), ids_before + count
                file = file or opened(path, "wb")
                file.write(b"".join(chunk))
                out = pd.DataFrame(rows, columns=[part.split()[0] for part in INDEX.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
        if file is not None:
            file.close()

    return run


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer file, special ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_records(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes records in ascending order of the id; returns the index.

    A null text is an empty one and gives a record of the end id alone; a null id sorts first. Rows that share an id
    are all written, in no set order between them. A text of any length is one record. An empty table gives an empty index and no file. Other columns are
    not read.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary_size(vocabulary), (end_id or 0) + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt.mapInPandas(_write(folder + "/data", vocabulary, end_id, width), INDEX).write.parquet(folder + "/index")
    return read_index(spark, folder)


def read_index(spark, folder: str) -> DataFrame:
    """The offset index of a folder of records."""
    return spark.read.parquet(folder + "/index")


def _payloads(rows: pd.DataFrame, held: dict) -> Iterator[bytes]:
    """Ids of index rows that are in order of file and offset; ``held`` keeps the open file."""
    for name, offset, size, width in zip(rows["file"], rows["offset"], rows["bytes"], rows["width"]):
        if held.get("name") != name:
            if "file" in held:
                held["file"].close()
            held["name"], held["file"] = name, opened(name, "rb")
        if held["file"].tell() != offset:
            held["file"].seek(offset)
        payload = unframe(held["file"].read(size + 16))
        yield payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()


def _ordered(frames: Iterator[pd.DataFrame], rows_together: int) -> Iterator[pd.DataFrame]:
    for rows in frames:
        rows = rows.sort_values(["file", "offset"], kind="stable")
        for start in range(0, len(rows), rows_together):
            yield rows[start : start + rows_together]


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for rows in _ordered(frames, READ_TOGETHER):
        yield rows.assign(ids=list(_payloads(rows, held)))


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for rows in _ordered(frames, 10_000):
        found = [(len(ids) // 4, zlib.crc32(ids)) for ids in _payloads(rows, held)]
        digests = pd.DataFrame(found, columns=["n_tokens", "ids_crc32"], index=rows.index)
        yield pd.concat([rows[["doc_id", "start"]].astype({"doc_id": "Int64"}), digests], axis=1)


def read_records(index: DataFrame) -> DataFrame:
    """The rows of an index with the ids of each record, as little-endian unsigned 32-bit integers, checks verified."""
    schema = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])
    return index.mapInPandas(_read, schema)


def with_starts(index: DataFrame, block: int = 1024) -> DataFrame:
    """The index with ``start``, the ids of all records before; sums over files are taken in two levels."""
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("in_file"))
    files = files.withColumn("block", F.floor(F.col("shard") / block))
    blocks = files.groupBy("block").agg(F.sum("in_file").alias("in_block"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("base"))
    earlier = W.partitionBy("block").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("inside", F.coalesce(F.sum("in_file").over(earlier), F.lit(0))).join(blocks, "block")
    files = files.select("shard", (F.col("base") + F.col("inside")).alias("file_start"))
    return index.join(files, "shard").withColumn("start", F.col("file_start") + F.col("ids_before")).drop("file_start")


def record_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the records of a table, reads them back and returns one row per document with what was read."""
    folder = new_folder(docs.sparkSession, "records")
    index = write_records(docs, vocabulary, folder, end_id)
    # digested where they are read: ids do not pass through the JVM
    return with_starts(index).mapInPandas(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
