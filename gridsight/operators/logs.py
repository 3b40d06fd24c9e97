"""Log lines and errors.

A line reads ``time||LEVEL||thread||class||message``. ``lines`` has log_offset
(unique, in file order, a number or any type with an order) and line; parsed logs add ts, level, thread,
class_name and message.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise

# Time pattern of a log line, and the text that shows a process is ready.
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss.SSS Z"
READY_MARKERS = {
    "zookeeper": "started",
    "kafka-server": "started (kafka.server.KafkaServer)",
    "spark-master": "Bound MasterWebUI",
    "spark-worker": "Successfully registered with master",
    "name-node": "initialization completed",
    "data-node": "Successfully sent block report",
}


def split_log_lines(lines: DataFrame) -> DataFrame:
    """Every line with its parts; ``ts`` is null when the line is malformed.

    The message is whatever follows the fourth separator, separators included.
    Times are wall-clock UTC. The parts come out of a generator, so that later
    filters work on them instead of taking the line apart once per condition.
    """
    part = [F.get("parts", F.lit(place)) for place in range(5)]
    ts = F.when(F.size("parts") == 5, F.try_to_timestamp(part[0], F.lit(TIME_PATTERN)).cast("timestamp_ntz"))
    fields = F.struct(
        ts.alias("ts"),
        F.trim(part[1]).alias("level"),
        part[2].alias("thread"),
        part[3].alias("class_name"),
        part[4].alias("message"),
    )
    return lines.withColumn("parts", F.split("line", r"\|\|", 5)).select(*lines.columns, F.inline(F.array(fields)))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """L1: the well-formed lines, taken apart."""
    return split_log_lines(lines).filter(F.col("ts").isNotNull()).drop("line")


def reject_log_lines(lines: DataFrame) -> DataFrame:
    """L1: the malformed lines, whole."""
    return split_log_lines(lines).filter(F.col("ts").isNull()).select(*lines.columns)


def search_logs(
    logs: DataFrame,
    query: str = "",
    levels: Sequence[str] = (),
    classes: Sequence[str] = (),
    start: Column | None = None,
    end: Column | None = None,
    last_offset: Column | int | None = None,
    n: int | None = None,
) -> DataFrame:
    """L2: lines that contain the text and pass the filters, after an offset.

    An empty set of levels or classes accepts all; the time range counts only
    when both ends are given, and includes them. ``n`` asks for one page, the
    first lines in offset order; without it every match comes, unsorted.
    """
    found = logs
    if query:
        found = found.filter(F.contains(F.col("message"), F.lit(query)))
    if levels:
        found = found.filter(F.col("level").isin(*levels))
    if classes:
        found = found.filter(F.col("class_name").isin(*classes))
    if start is not None and end is not None:
        found = found.filter(F.col("ts").between(start, end))
    if last_offset is not None:
        found = found.filter(F.col("log_offset") > last_offset)
    found = found.select("log_offset", "ts", "level", "thread", "class_name", "message")
    return found if n is None else found.orderBy("log_offset").limit(n)


def search_log_lines(lines: DataFrame, query: str = "", levels: Sequence[str] = (), **filters) -> DataFrame:
    """L2 on lines as written: those that cannot match are passed over before they are taken apart.

    A message holds the text only if its line does, and the same goes for levels.
    """
    if query:
        lines = lines.filter(F.contains(F.col("line"), F.lit(query)))
    if levels:
        lines = lines.filter(reduce(or_, [F.contains(F.col("line"), F.lit(level)) for level in levels]))
    return search_logs(parse_log_lines(lines), query, levels, **filters)


def log_facets(logs: DataFrame) -> DataFrame:
    """L3: size, first and last time and last offset of a result, whole and per level and class.

    One row per facet value instead of arrays, so the number of classes does
    not matter. Lines are reduced per level and class first; the three groupings
    are made of that table.
    """
    level, class_name = F.col("level"), F.col("class_name")
    pairs = logs.groupBy(level, class_name).agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("log_offset").alias("last_offset"),
    )
    grouped = pairs.groupingSets([[], [level], [class_name]], level, class_name).agg(
        F.grouping_id().alias("grouping"),
        F.sum("lines").alias("lines"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("last_offset").alias("last_offset"),
    )
    facet = (
        F.when(F.col("grouping") == 3, F.lit("all")).when(F.col("grouping") == 1, F.lit("level")).otherwise(F.lit("class"))
    )
    return grouped.select(
        facet.alias("facet"),
        F.when(F.col("grouping") == 1, level).when(F.col("grouping") == 2, class_name).alias("value"),
        "lines", "first_ts", "last_ts", "last_offset",
    )


def startup_milestones(logs: DataFrame, markers: Mapping[str, str] = READY_MARKERS) -> DataFrame:
    """L4: the first line of each thread that contains each ready marker.

    Markers are a parameter and travel as a literal, so there is no join. Lines
    without any marker, nearly all of them, are dropped by a plain filter first.
    """
    some = reduce(or_, [F.contains(F.col("message"), F.lit(text)) for text in markers.values()])
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in markers.items()])
    hits = logs.filter(some).select(
        "thread",
        "log_offset",
        "ts",
        "message",
        F.explode(F.filter(table, lambda marker: F.contains(F.col("message"), marker["text"]))).alias("marker"),
    )
    return (
        hits.groupBy("thread", F.col("marker.name").alias("milestone"))
        .agg(F.min_by(F.struct("log_offset", "ts", "message"), "log_offset").alias("first"))
        .select("thread", "milestone", "first.log_offset", "first.ts", "first.message")
    )


def error_rollup(errors: DataFrame) -> DataFrame:
    """Errors by severity, source and cause. Formula is ours: a plain count."""
    return errors.groupBy(
        normalise(F.col("severity"), "severity").alias("severity"),
        normalise(F.col("source"), "error_source").alias("source"),
        "cause",
    ).agg(F.count(F.lit(1)).alias("errors"))


def error_traces(errors: DataFrame) -> DataFrame:
    """How often each frame appears in the stack traces of a cause.

    Errors without a trace count under a null frame.
    """
    return (
        errors.select("cause", F.explode_outer("traces").alias("frame"))
        .groupBy("cause", "frame.class_name", "frame.method_name", "frame.line_number")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
