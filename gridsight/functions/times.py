"""Spans of time and instants as numbers and text.

Wall-clock times are ``timestamp_ntz`` in UTC. Sessions run in UTC, so turning
them into instants and back is a cast, much cheaper than calendar arithmetic.
Every function takes the present moment as an argument where it needs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_down, half_up, int_div, short_tenths_text, tenths_text

# Lengths of the units in seconds and milliseconds.
MINUTE_S, HOUR_S, DAY_S, MONTH_S, YEAR_S = 60, 3600, 86400, 2592000, 31536000
SECOND, MINUTE, HOUR, DAY, MONTH, YEAR = 1000, 60000, 3600000, 86400000, 2592000000, 31536000000


def moment(text: str) -> Column:
    """A literal wall-clock time."""
    return F.lit(text).cast("timestamp_ntz")


def _instant(ts: Column | str) -> Column:
    """The instant at which a clock of the session's zone, UTC, shows the time."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a wall-clock time."""
    return F.unix_millis(_instant(ts))


def epoch_s(ts: Column | str) -> Column:
    return F.unix_seconds(_instant(ts))


def from_epoch_ms(ms: Column) -> Column:
    """Wall-clock time of milliseconds since 1970."""
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def elapsed_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two wall-clock times."""
    return int_div(F.unix_micros(_instant(end)) - F.unix_micros(_instant(start)), 1000)


def _text(number: Column, unit: str) -> Column:
    return F.concat(number.cast("string"), F.lit(f" {unit}"))


def format_interval(seconds: Column) -> Column:
    """Seconds in the largest whole unit, e.g. ``5 mins``.

    A span of exactly one year reads ``1 yrs``.
    """
    return (
        F.when(seconds < MINUTE_S, _text(seconds, "secs"))
        .when(seconds < HOUR_S, _text(int_div(seconds, MINUTE_S), "mins"))
        .when(seconds < DAY_S, _text(int_div(seconds, HOUR_S), "hrs"))
        .when(seconds < MONTH_S, _text(int_div(seconds, DAY_S), "days"))
        .when(seconds < YEAR_S, _text(int_div(seconds, MONTH_S), "mon"))
        .otherwise(_text(int_div(seconds, YEAR_S), "yrs"))
    )


def _calendar_tail(branches: Column, ms: Column) -> Column:
    return (
        branches.when(ms < MONTH, _text(half_down(ms, DAY), "d"))
        .when(ms < YEAR, _text(int_div(ms, MONTH), "mo"))
        .otherwise(_text(int_div(ms, YEAR), "y"))
    )


def format_interval_ms(ms: Column) -> Column:
    """Milliseconds with whole units; hours carry one decimal.

    Seconds round half up, minutes to days half down, months and years floor.
    """
    branches = (
        F.when(ms < SECOND, _text(ms, "ms"))
        .when(ms < MINUTE, _text(half_up(ms, SECOND), "s"))
        .when(ms < HOUR, _text(half_down(ms, MINUTE), "m"))
        .when(ms < DAY, _text(tenths_text(half_down(ms, HOUR, 10)), "h"))
    )
    return _calendar_tail(branches, ms)


def format_interval_ms_decimal(ms: Column) -> Column:
    """As :func:`format_interval_ms` with one decimal from seconds to hours."""
    branches = (
        F.when(ms < SECOND, _text(ms, "ms"))
        .when(ms < MINUTE, _text(tenths_text(half_up(ms, SECOND, 10)), "s"))
        .when(ms < HOUR, _text(tenths_text(half_down(ms, MINUTE, 10)), "m"))
        .when(ms < DAY, _text(tenths_text(half_down(ms, HOUR, 10)), "h"))
    )
    return _calendar_tail(branches, ms)


def format_interval_ms_days(ms: Column) -> Column:
    """One decimal, half up, days as the largest unit."""
    return (
        F.when(ms < SECOND, _text(ms, "ms"))
        .when(ms < MINUTE, _text(tenths_text(half_up(ms, SECOND, 10)), "s"))
        .when(ms < HOUR, _text(tenths_text(half_up(ms, MINUTE, 10)), "m"))
        .when(ms < DAY, _text(tenths_text(half_up(ms, HOUR, 10)), "h"))
        .otherwise(_text(tenths_text(half_up(ms, DAY, 10)), "d"))
    )


def time_elapsed(start: Column | str, end: Column, now: Column | None = None) -> Column:
    """Span text between two moments; an open end is ``now``."""
    return format_interval_ms(elapsed_ms(start, end if now is None else F.coalesce(end, now)))


def time_elapsed_fraction(start: Column | str, end: Column, now: Column | None = None) -> Column:
    """As :func:`time_elapsed` with one decimal up to hours."""
    return format_interval_ms_decimal(elapsed_ms(start, end if now is None else F.coalesce(end, now)))


def split_ms(ms: Column) -> Column:
    """Days, hours, minutes, seconds, milliseconds; towards zero (X11)."""
    return F.struct(
        int_div(ms, DAY).alias("days"),
        (int_div(ms, HOUR) % 24).alias("hours"),
        (int_div(ms, MINUTE) % 60).alias("minutes"),
        (int_div(ms, SECOND) % 60).alias("seconds"),
        (ms % 1000).alias("milliseconds"),
    )


def time_unit(ms: Column) -> Column:
    """Unit in which a run time is shown; a unit starts above its length."""
    return (
        F.when(ms > DAY, F.lit("day")).when(ms > HOUR, F.lit("hrs")).when(ms > MINUTE, F.lit("mins")).otherwise(F.lit("sec"))
    )


def tenths_in_unit(ms: Column, unit: Column) -> Column:
    """Tenths of the unit, rounded half up."""
    length = F.when(unit == "day", DAY).when(unit == "hrs", HOUR).when(unit == "mins", MINUTE).when(unit == "sec", SECOND)
    return half_up(ms, length.cast("bigint"), 10)


def ms_in_unit(ms: Column, unit: Column) -> Column:
    """The value in the unit with one decimal, as a number."""
    return tenths_in_unit(ms, unit) / F.lit(10.0)


def readable_time(ms: Column) -> Column:
    """Run time text; exactly 1000 ms stays ``1000 ms``."""
    unit = time_unit(ms)
    label = F.when(unit == "sec", F.lit("secs")).when(unit == "day", F.lit("days")).otherwise(unit)
    return F.when(ms > SECOND, F.concat(short_tenths_text(tenths_in_unit(ms, unit)), F.lit(" "), label)).otherwise(
        _text(ms, "ms")
    )


def message_time(ms: Column) -> Column:
    """Display time of a message."""
    return F.date_format(from_epoch_ms(ms), "dd-MM-yyyy HH:mm:ss.SSS")
