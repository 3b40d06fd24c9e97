"""Bounded samples of labelled documents to fit classifiers on, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of an id: CRC-32 of its digits, modulo the folds; a null id is in none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    """Whether labels of an id are kept from fitting."""
    return F.coalesce(fold(doc_id, folds) == held, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, all_chars: int
) -> DataFrame:
    """Texts with their label, from at most ``rows`` labelled ids outside the held-out fold.

    Ids are chosen by a hash of the id, so that reruns agree; an id with several labels counts by the highest, one without
    a label is no candidate. Ids are taken in the order of the hash until their texts together reach ``all_chars`` characters,
    the last one whole, so that no text is too long to be taken. The chosen labels are written first: they are few, and Spark sees from their size
    that they can be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"), folds, held))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = saved(known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(label)), "doc_id").limit(rows), "labelled-" + label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row per chosen id, at most ``rows`` of them, so that a window without a key is small
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.col("text").cast("string")).alias("chars"))
    sizes = sizes.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.sum("chars").alias("chars"))
    earlier = W.orderBy(F.xxhash64(F.col("doc_id"), F.lit(label)), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    taken = sizes.where("chars IS NOT NULL").withColumn("before", F.coalesce(F.sum("chars").over(earlier), F.lit(0)))
    taken = saved(taken.where(F.col("before") < all_chars).select("doc_id", "label"), "taken-" + label)
    return saved(texts.where("text IS NOT NULL").join(taken, "doc_id").select("doc_id", "label", "text"), "sampled-" + label)
