"""Sums and predecessors in time for keys with very many rows.

Rows of a key are cut into spans of time of a fixed length. What a span adds up to, or ends with, is followed from span
to span, where there are few rows, and rows are ordered within their span only. So a hot key is worked on by as many
tasks as it has spans, and the plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_reduced


def span(ts: str, span_s: int) -> Column:
    """Number of the span of time a row lies in; null for a null time."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(span_s * 1_000_000))


def with_earlier(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, span_s: int) -> DataFrame:
    """Adds ``name``: a struct of ``column`` of the row before in a key, by ``order``, whose first column is a time; null for the first."""
    rows = rows.withColumn("span", span(order[0], span_s))
    place = F.struct(*order)
    last = rows.groupBy(*keys, "span").agg(F.max_by(F.struct(column), place).alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("span")).alias("ended")
    ended = last.select(*keys, "span", before)
    inside = Window.partitionBy(*keys, "span").orderBy(*order)
    joined = join_reduced(rows, ended, [*keys, "span"], "left")
    return joined.withColumn(name, F.coalesce(F.lag(F.struct(column)).over(inside), F.col("ended"))).drop("span", "ended")


def with_position(rows: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], name: str, span_s: int) -> DataFrame:
    """Adds the place of each row of a key, from 1, latest ``time`` first, then by ``ties`` from the largest down; rows without a time come last."""
    rows = rows.withColumn("span", span(time, span_s))
    counts = rows.groupBy(*keys, "span").agg(F.count(F.lit(1)).alias("rows"))
    later = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("span")).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "span", F.coalesce(F.sum("rows").over(later), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*keys, "span").orderBy(F.desc_nulls_last(time), *[F.desc_nulls_last(tie) for tie in ties])
    joined = join_reduced(rows, bases, [*keys, "span"], "left")
    return joined.withColumn(name, F.col("ahead") + F.row_number().over(inside)).drop("span", "ahead")


def with_running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], span_s: int) -> DataFrame:
    """Replaces each of ``columns`` by its sum over the rows of the key up to this one, by ``order``, whose first column is a time."""
    rows = rows.withColumn("span", span(order[0], span_s))
    sums = rows.groupBy(*keys, "span").agg(*[F.sum(name).alias(name) for name in columns])
    earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "span", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_base") for name in columns])
    inside = Window.partitionBy(*keys, "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_reduced(rows, bases, [*keys, "span"], "left")
    running = {name: F.sum(name).over(inside) + F.col(f"{name}_base") for name in columns}
    others = [name for name in rows.columns if name not in (*columns, "span")]
    return joined.select(*others, *[total.alias(name) for name, total in running.items()])
