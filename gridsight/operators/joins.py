"""Joining rows with a table that was reduced to one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_reduced(rows: DataFrame, reduced: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Columns of ``rows`` followed by the other columns of ``reduced``; null keys match.

    Adaptive execution splits a hot key only when both sides are shuffled for
    the join. A reduced side is already partitioned by its key and would not be.
    The null-safe comparison has Spark shuffle it once more, small as it is, and
    keeps an aggregate that follows from relying on the join's partitioning, so
    it combines before its own shuffle.
    """
    own = [name for name in reduced.columns if name not in keys]
    other = reduced.select(*[F.col(key).alias(f"reduced_{key}") for key in keys], *own)
    same_key = reduce(and_, [F.col(key).eqNullSafe(F.col(f"reduced_{key}")) for key in keys])
    return rows.join(other, same_key, how).drop(*[f"reduced_{key}" for key in keys])
