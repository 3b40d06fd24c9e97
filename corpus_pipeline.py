"""A corpus made ready for training: toxic documents go, copies and near copies go, sources are mixed, the rest is packed.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridsight.llm import mixing, naming, packing, parity_join, toxicity
from gridsight.llm.common import ready, saved, table
from gridsight.llm.queries import vocabulary
from gridsight.storage import folders, remove


#: Parts of text a worker remembers while it packs, fewer than where packing runs alone: executors still hold what the stages before took.
PACKING_PARTS = 100_000


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model fitted on the labels."""
    ready(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ready(spark)
    return naming.without_duplicates(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return parity_join.one_per_component(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    ready(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    ready(spark)
    return packing.pack(docs, vocabulary(), kept_parts=PACKING_PARTS)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", unique),
    ("near_duplicates", distinct),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages fit a model, round at random and encode tokens, which SQL does not express; tests hold what each stage keeps
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    When a stage is written, the tables it made on the way and the result of the stage before are removed; those of the
    last stage stay, since its result still reads them.
    """
    docs, needed = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = len(folders(spark))
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name)
        made = folders(spark)[before:]
        remove(spark, [*needed, *made[:-1]])
        needed = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
