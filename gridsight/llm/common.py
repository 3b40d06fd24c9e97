"""What the operators of this package share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..storage import new_folder

#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: A word: a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of a batch of rows that Python gets at once; long texts would otherwise come ten thousand at a time.
ARROW_BYTES = "4m"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Settings the operators count on; Python workers can import this package where the folder exists."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a short lineage, a known size, a result that stays."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def without_spaces(text: Column) -> Column:
    """A text without its separators; a null text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")
