"""Counting identical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_copies(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct combination of the columns once, with its number in ``copies``.

    Copies are combined before the shuffle, and rows of a hot key are spread by
    the remaining columns, so no task holds a whole key.
    """
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
