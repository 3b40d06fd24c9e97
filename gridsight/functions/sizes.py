"""Byte counts as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up, int_div, tenths_text

# Unit names in order of size.
BINARY_LETTERS = ["K", "M", "G", "T", "P", "E"]
DISPLAY_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def readable_size(size: Column) -> Column:
    """Signed size with one decimal in binary units.

    A unit is left for the next one where its text would read 1024.0, which is from 1023.95 of it. The value shown is
    rounded from whole units of the next smaller kind.
    """
    # the lowest integer has no positive counterpart; it shows like its neighbour
    amount = F.abs(F.greatest(size, F.lit(1 - 2**63)))
    sign = F.when(size < 0, "-").otherwise("")

    def shown(power: int) -> Column:
        tenths = half_up(int_div(amount, 1024 ** (power - 1)), 1024, 10)
        return F.concat(sign, tenths_text(tenths), F.lit(f" {BINARY_LETTERS[power - 1]}B"))

    text = shown(len(BINARY_LETTERS))
    for power in range(len(BINARY_LETTERS) - 1, 0, -1):
        text = F.when(amount <= 20479 * 1024**power // 20, shown(power)).otherwise(text)
    return F.when(amount < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(text)


def _display(size: Column, divisor: int) -> Column:
    text = F.when(size == 0, F.lit("0 B")).when(size < 1024, F.concat(size.cast("string"), F.lit(" Bytes")))
    for power in range(1, 5):
        unit = divisor**power
        tenths = int_div(size, unit) * 10 + half_up(size % unit, unit, 10)
        shown = F.concat(tenths_text(tenths), F.lit(f" {DISPLAY_UNITS[power]}"))
        text = text.when(size < 1024 ** (power + 1), shown) if power < 4 else text.otherwise(shown)
    return text


def bytes_to_size(size: Column) -> Column:
    """Size with one decimal of powers of 1024; terabytes are the largest unit."""
    return _display(size, 1024)


def bytes_to_decimal_size(size: Column) -> Column:
    """Unit chosen by powers of 1024, value divided by powers of 1000."""
    return _display(size, 1000)
