"""Exact deduplication by deterministic block naming (operator 9); DataFrame functions only.

A text without its separators is cut into blocks of a fixed number of characters. Equal blocks get one integer, their
name: blocks meet by a 64-bit fingerprint, the distinct texts of a fingerprint are sorted, and a fingerprint and place
in that order get a number of their own. Two blocks therefore share a name only if they are equal; the fingerprint
merely brings them together. Adjacent names are then paired, distinct pairs numbered, and so on, which halves the names
of a document each round, until one is left. Documents with the same last name of the same round are equal.

Text is shuffled once, for the distinct blocks; what follows moves integers. Blocks combine before that shuffle, so a
hot text is sent once per task, and joins on a hot name are split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, without_spaces

#: Characters of a block.
BLOCK = 8192
#: Stands for the missing right name at the end of an odd row of names.
NOTHING = -1


def blocks_of(body: Column, size: int = BLOCK) -> Column:
    """A text as an array of blocks; an empty text is one empty block."""
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(body) <= size, F.array(body)).otherwise(cut)


def _blocks(docs: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    text = F.col(text_column).cast("string")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
        without_spaces(text).alias("body"),
    )
    blocks = blocks_of(F.col("body"), size)
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("blocks", blocks)


def _named_blocks(docs: DataFrame, id_column: str, text_column: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Names of fingerprints and places, and the blocks of fingerprints that several blocks share."""
    blocks = _blocks(docs, id_column, text_column, size).select(F.explode("blocks").alias("block"))
    found = blocks.select(F.xxhash64("block").alias("print"), "block").groupBy("print").agg(F.collect_set("block").alias("set"))
    several = F.size("set") > 1
    listed = found.select("print", F.posexplode(F.sort_array("set")).alias("place", "block"), several.alias("several"))
    named = listed.select("print", "place", F.when(F.col("several"), F.col("block")).alias("block"))
    named = saved(named.withColumn("name", F.monotonically_increasing_id()), "naming-blocks")
    collided = saved(named.where("block IS NOT NULL").select("print", "place", "block"), "naming-collided")
    return named.select("print", "place", "name"), collided


def identities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per row of the table: row, doc_id, n_chars, text_sha256 and its identity, a round and a name."""
    names, collided = _named_blocks(docs, id_column, text_column, size)
    rows = _blocks(docs, id_column, text_column, size)
    one = rows.select(
        "row", "doc_id", "n_chars", F.sha2("body", 256).alias("text_sha256"), F.size("blocks").alias("left"),
        F.posexplode("blocks").alias("at", "block"),
    ).withColumn("print", F.xxhash64("block"))
    one = one.join(collided, ["print", "block"], "left").withColumn("place", F.coalesce("place", F.lit(0))).drop("block")
    kept = ["row", "doc_id", "n_chars", "text_sha256", "left", "at", "name"]
    level = saved(one.join(names, ["print", "place"]).select(*kept), "naming-level")
    rounds = (max(level.agg(F.max("left")).first()[0] or 1, 1) - 1).bit_length()
    done = [level.where("left = 1").withColumn("round", F.lit(0))]
    for turn in range(1, rounds + 1):
        right = F.col("at") % 2 == 1
        pairs = level.where("left > 1").groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
            *[F.first(name).alias(name) for name in ("doc_id", "n_chars", "text_sha256")],
            F.ceil(F.first("left") / 2).cast("int").alias("left"),
            F.max(F.when(~right, F.col("name"))).alias("first_name"),
            F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(NOTHING)).alias("second_name"),
        )
        both = ["first_name", "second_name"]
        numbered = saved(pairs.select(*both).distinct().withColumn("name", F.monotonically_increasing_id()), "naming-pairs")
        level = saved(pairs.join(numbered, both).select(*kept), "naming-level")
        done.append(level.where("left = 1").withColumn("round", F.lit(turn)))
    return reduce(DataFrame.unionAll, done).select("row", "doc_id", "n_chars", "text_sha256", "round", "name")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = BLOCK
) -> DataFrame:
    """One row per row of the table: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when they are the same without separators; a null text counts as empty, and all empty ones are equal.
    Of equal texts the row with the most characters stays, then the one with the smallest id (a null id last), and of
    repeated rows one. Texts are used whole, however long. An empty table gives an empty one. Other columns are not read.
    """
    named = identities(docs, id_column, text_column, size)
    rank = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    groups = named.groupBy("round", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    groups = saved(groups, "naming-groups")  # a join of two shuffles is one that a hot name does not hold up
    return named.join(groups, ["round", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "n_chars",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, columns as they were; of repeated rows one stays."""
    keep = exact_duplicates(docs).where("kept")
    keep = keep.select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"), F.col("n_chars").alias("__keep_chars"))
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__sha", F.sha2(without_spaces(text), 256))
    keyed = keyed.withColumn("__chars", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    same = keyed["doc_id"].cast("long").eqNullSafe(keep["__keep_id"])
    same = same & (keyed["__sha"] == keep["__keep_sha"]) & (keyed["__chars"] == keep["__keep_chars"])
    joined = keyed.join(keep, same)
    # rows that share id, text and length: one of them stays
    alike = W.partitionBy("__keep_id", "__keep_sha", "__keep_chars").orderBy(F.lit(0))
    return joined.withColumn("__turn", F.row_number().over(alike)).where("__turn = 1").select(*docs.columns)
