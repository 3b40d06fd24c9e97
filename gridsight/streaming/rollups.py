"""States of clusters that follow the changes of their processes one by one.

A change moves its process from one status to another, so it adds to or takes
from the number of processes known, running and stopped. The sums of these
steps up to a change tell whether all processes agree after it. Changes that
repeat a status move nothing and leave before the changes of a cluster meet.
Both the status before a change and the sums are found within spans of time and
from span to span, so that a process or cluster with very many changes is worked
on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_reduced
from ..operators.registry import process_counts, rollup_expression
from ..operators.spans import with_earlier, with_running_sums

PROCESS = ["cluster_id", "name"]
COUNTS = ["processes", "running", "stopped"]
SPAN_S = 600


def newest_changes(before: DataFrame, changes: DataFrame) -> DataFrame:
    """Newest change of each process."""
    columns = [*PROCESS, "ts", "seq", "status"]
    newest = F.max_by(F.struct("ts", "seq", "status"), F.struct("ts", "seq")).alias("newest")
    both = before.select(*columns).unionByName(changes.select(*columns))
    return both.groupBy(*PROCESS).agg(newest).select(*PROCESS, "newest.*")


def _moves(before: DataFrame, changes: DataFrame, span_s: int) -> DataFrame:
    """Changes that give a process another status, with what they add to the counts of its cluster."""
    known = before.select(*PROCESS, F.struct("ts", "seq").alias("known"), F.col("status").alias("known_status"))
    joined = join_reduced(changes.select(*PROCESS, "ts", "seq", "status"), known, PROCESS, "left")
    fresh = joined.filter(F.col("known").isNull() | (F.struct("ts", "seq") > F.col("known")))
    stepped = with_earlier(fresh, PROCESS, ["ts", "seq"], "status", "earlier", span_s)
    first = F.col("known").isNull() & F.col("earlier").isNull()
    was = F.when(F.col("earlier").isNotNull(), F.col("earlier.status")).otherwise(F.col("known_status"))
    stepped = stepped.withColumn("first", first).withColumn("was", was)

    def added(status: str) -> Column:
        return F.col("status").eqNullSafe(status).cast("bigint") - F.col("was").eqNullSafe(status).cast("bigint")

    return stepped.filter(F.col("first") | ~F.col("status").eqNullSafe(F.col("was"))).select(
        *PROCESS, "ts", "seq",
        F.col("first").cast("bigint").alias("processes"),
        added("running").alias("running"),
        added("stopped").alias("stopped"),
    )


def last_agreed(before: DataFrame, changes: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """State of each cluster with moves, by the last change after which all its known processes agree; null without one.

    ``before`` holds the newest earlier change of each process. ``span_s`` is the length of a span of time; a task sorts
    the changes of one cluster in one span. The changes are read more than once.
    """
    counted = process_counts(before).select("cluster_id", *[F.col(name).alias(f"{name}_before") for name in COUNTS])
    moves = with_running_sums(_moves(before, changes, span_s), ["cluster_id"], ["ts", "seq", "name"], COUNTS, span_s)
    followed = join_reduced(moves, counted, ["cluster_id"], "left")
    totals = [F.col(name) + F.coalesce(f"{name}_before", F.lit(0)) for name in COUNTS]
    agreed = rollup_expression(*totals, F.lit(None).cast("string"))
    place = F.when(F.col("agreed").isNotNull(), F.struct("ts", "seq", "name"))
    return followed.withColumn("agreed", agreed).groupBy("cluster_id").agg(F.max_by("agreed", place).alias("status"))


def carried_on(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each cluster with its new state, or else its old one, or else ``unknown``."""
    both = old.select("cluster_id", "status", F.lit(0).alias("turn")).unionByName(new.select("cluster_id", "status", F.lit(1).alias("turn")))
    latest = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("turn")))
    return both.groupBy("cluster_id").agg(F.coalesce(latest, F.lit("unknown")).alias("status"))
