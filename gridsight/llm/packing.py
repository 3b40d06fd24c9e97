"""Packing of documents into fixed windows by minimum bin slack (operator 8).

A document is cut at multiples of the window; each full piece is a sequence of its own, and what is left, the tail, is
shorter than a window. Tails are packed by their lengths alone: a histogram of tail lengths, which has fewer rows than
a window has tokens whatever the size of the corpus, is all the planner sees. It takes the longest tail that is left
and asks which multiset of the others fills the rest of the window best. A bitset holds every sum that the remaining
counts can reach, length by length; the best sum is backtracked into a count of each length. The pattern found is used
as often as the counts allow, which uses up at least one length, so patterns are few however many tails there are.

Spark then ranks the tails of each length and a join with the plan, bounded by the window, gives each its sequence and
place. Ranks are taken in hashed buckets, so that a length that a third of all documents share is ranked in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .encoding import KEPT_PARTS, encoder, packed
from .records import BATCH_CHARS, batches_of

#: Buckets at least, and documents a bucket about holds when there are more.
BUCKETS = 256
BUCKET_ROWS = 100_000
PLAN = "tail int, low bigint, high bigint, uses bigint, first_sequence bigint, at bigint"


def padding(used: int, capacity: int) -> int:
    """Tokens a sequence is padded by; none at a power of two."""
    return 0 if used & (used - 1) == 0 else capacity - used


def reachable(counts: dict[int, int], limit: int) -> list[tuple[int, int, int]]:
    """The sums up to a limit as bitsets: (length, sums before it, sums with it), longest first, until the limit is met."""
    mask, sums, steps = (1 << (limit + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > limit:
            continue
        left, step, before = min(counts[length], limit // length), 1, sums
        while left > 0:
            taken = min(step, left)
            sums |= (sums << (length * taken)) & mask
            left, step = left - taken, step * 2
        steps.append((length, before, sums))
        if sums >> limit & 1:
            break
    return steps


def backtracked(steps: list[tuple[int, int, int]], total: int) -> dict[int, int]:
    """How often each length is used to reach a sum."""
    uses = {}
    for length, before, _ in reversed(steps):
        times = 0
        while not before >> total & 1:
            total, times = total - length, times + 1
        if times:
            uses[length] = times
    return uses


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns, each with how many sequences use it, that hold every tail of a histogram of lengths below the capacity."""
    counts, plan = {length: count for length, count in histogram.items() if count > 0}, []
    while counts:
        longest = max(counts)
        rest = {**counts, longest: counts[longest] - 1}
        steps = reachable({length: count for length, count in rest.items() if count}, capacity - longest)
        sums = steps[-1][2] if steps else 1
        if sums >> (capacity - longest) & 1:
            best = capacity - longest
        else:
            found = (total for total in range(capacity - longest, -1, -1) if sums >> total & 1)
            best = min(found, key=lambda total: (padding(longest + total, capacity), -total))
        pattern = backtracked(steps, best)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[length] // uses for length, uses in pattern.items())
        plan.append((pattern, times))
        for length, uses in pattern.items():
            counts[length] -= uses * times
            if not counts[length]:
                del counts[length]
    return plan


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """The plan as ranges of ranks of each length, and the number of sequences in it."""
    rows, used, sequences = [], {}, 0
    for pattern, times in plan:
        place = 0
        for length in sorted(pattern, reverse=True):
            uses, low = pattern[length], used.get(length, 0)
            rows.append((length, low, low + uses * times, uses, sequences, place))
            used[length] = low + uses * times
            place += uses * length
        sequences += times
    return rows, sequences


def _cut(vocabulary: str, end_id: int, capacity: int, kept: int):
    end, width = packed([end_id]), 4 * capacity

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            texts, doc_ids = rows["text"].tolist(), rows["doc_id"].astype("Int64")
            for start, stop in batches_of(texts, BATCH_CHARS):
                out = []
                for ids in encoder(vocabulary, kept).batch(texts[start:stop]):
                    ids += end
                    full = len(ids) // width
                    crcs = [zlib.crc32(ids[place * width : (place + 1) * width]) for place in range(full)]
                    out.append((len(ids) // 4, crcs, len(ids) // 4 - full * capacity, zlib.crc32(ids[full * width :])))
                made = pd.DataFrame(out, columns=["doc_tokens", "crcs", "tail", "tail_crc"])
                made.insert(0, "doc_id", doc_ids[start:stop].array)
                yield made

    return run


def cut_documents(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text", kept_parts: int = KEPT_PARTS
) -> DataFrame:
    """Per document: its tokens with the end id, a checksum of each full piece, and the length and checksum of its tail."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, tail int, tail_crc bigint"
    return rows.mapInPandas(_cut(vocabulary, end_id, capacity, kept_parts), schema)


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
    kept_parts: int = KEPT_PARTS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of the table is packed, repeated rows each on their own. A null or empty text is its end id alone. A null
    id stays null. A text of any length is cut whole. An empty table gives no piece. Other columns are not read. A worker
    remembers ``kept_parts`` parts in each of two generations, which decides on its memory and time alone.
    """
    spark = docs.sparkSession
    cut = saved(cut_documents(docs, vocabulary, capacity, end_id, id_column, text_column, kept_parts), "packing-cut")
    buckets = max(BUCKETS, cut.count() // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tail_crc", "doc_tokens"), F.lit(buckets)))
    # at most one row per length below the window
    histogram = {row["tail"]: row["count"] for row in cut.where("tail > 0").groupBy("tail").count().collect()}
    rows, sequences = plan_rows(plan_windows(histogram, capacity))

    # sums over buckets give what stands before each bucket
    sums = cut.groupBy("bucket", "tail").agg(F.count(F.lit(1)).alias("rows_here"), F.sum(F.size("crcs")).alias("full_here"))
    of_tail = W.partitionBy("tail").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    tails = sums.select("bucket", "tail", F.coalesce(F.sum("rows_here").over(of_tail), F.lit(0)).alias("tails_before"))
    of_all = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    full = sums.groupBy("bucket").agg(F.sum("full_here").alias("full_here"))
    full = full.select("bucket", F.coalesce(F.sum("full_here").over(of_all), F.lit(0)).alias("full_before"))

    order = ["doc_id", "tail_crc", "doc_tokens"]
    earlier = W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = cut.withColumn("full_inside", F.coalesce(F.sum(F.size("crcs")).over(earlier), F.lit(0)))
    ranked = ranked.withColumn("tail_inside", F.row_number().over(W.partitionBy("bucket", "tail").orderBy(*order)) - 1)
    ranked = ranked.join(tails, ["bucket", "tail"]).join(full, "bucket")
    ranked = ranked.withColumn("rank", F.col("tail_inside") + F.col("tails_before"))

    # the plan is bounded by the window: a pattern uses a length up, and holds few lengths
    plan = F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("tail", "length_planned"))
    inside = (F.col("tail") == F.col("length_planned")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(plan, inside, "left")
    turn = F.col("rank") - F.col("low")
    tail = F.struct(
        (F.size("crcs") * F.lit(capacity)).cast("long").alias("start"),
        F.col("tail").cast("long").alias("length"),
        F.col("tail_crc").alias("ids_crc32"),
        (F.col("first_sequence") + F.floor(turn / F.col("uses"))).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("uses")) * F.col("tail")).alias("offset"),
    )
    whole = F.transform(
        "crcs",
        lambda crc, place: F.struct(
            (place * F.lit(capacity)).cast("long").alias("start"),
            F.lit(capacity).cast("long").alias("length"),
            crc.alias("ids_crc32"),
            (F.lit(sequences) + F.col("full_before") + F.col("full_inside") + place).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        ),
    )
    pieces = F.when(F.col("tail") > 0, F.concat(whole, F.array(tail))).otherwise(whole)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select("doc_id", "doc_tokens", F.inline(pieces)).select(*names)
