"""Integer rounding, so that text never depends on floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str | int) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value).cast("bigint") if isinstance(value, int) else value


def int_div(value: Column | str | int, by: Column | str | int) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", as_column(value), as_column(by))


def half_up(value: Column, unit: Column | int, scale: int = 1) -> Column:
    """``value * scale / unit`` rounded to an integer, ties up (value >= 0)."""
    unit = as_column(unit)
    return int_div(value * (2 * scale) + unit, unit * 2)


def half_down(value: Column, unit: Column | int, scale: int = 1) -> Column:
    """``value * scale / unit`` rounded to an integer, ties down (value >= 0)."""
    unit = as_column(unit)
    return int_div(value * (2 * scale) + unit - 1, unit * 2)


def tenths_text(tenths: Column) -> Column:
    """A count of tenths as text with exactly one decimal."""
    return F.concat(int_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_tenths_text(tenths: Column) -> Column:
    """A count of tenths as text, without a trailing ``.0``."""
    return F.when(tenths % 10 == 0, int_div(tenths, 10).cast("string")).otherwise(tenths_text(tenths))


def int_mean(total: Column, count: Column) -> Column:
    """Mean of non-negative integers, rounded half up; null for an empty group."""
    return F.when(count > 0, half_up(total, F.when(count > 0, count)))


def percent(value: Column, total: Column) -> Column:
    """Whole percent, rounded half up; null when the total is zero."""
    total = F.when(total != 0, total)
    return half_up(value, total, 100)


def fraction_percent(fraction: Column) -> Column:
    """A fraction as ``N%``."""
    return F.concat(F.round(fraction * 100).cast("bigint").cast("string"), F.lit("%"))
