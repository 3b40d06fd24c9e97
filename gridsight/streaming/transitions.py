"""Status changes that arrive too late to be believed.

While a cluster is starting, ``new`` and ``terminated`` are leftovers; while it
is terminating, ``running`` is. A leftover is dropped and does not change the
state it is compared with.

Every other status is always believed, so it settles the state; call it an
anchor. After a ``starting`` anchor leftovers end with the first ``running``,
after a ``terminating`` one with the first ``new`` or ``terminated``. Whether a
row is a leftover therefore follows from three row numbers before it: those of
the last anchor, the last ``running`` and the last ``new`` or ``terminated``.

Rows of a cluster are cut into spans of time of a fixed length. Each span is
summed up by the state it settles or releases, the sums are followed from span
to span, and rows are numbered within their span. A cluster with very many rows
is thus judged by many tasks, and the plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ENDED = ["new", "terminated"]
# States that matter: leftovers of a start, leftovers of a stop, or none.
STARTING, TERMINATING, OPEN = 1, 2, 3
CHANGE = ["cluster_id", "ts", "seq", "status"]
CHANGE_SCHEMA = "cluster_id bigint, ts timestamp_ntz, seq bigint, status string"
SPAN_S = 3600


def _span(span_s: int) -> Column:
    """Number of the span of time a row lies in."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return F.floor(micros / F.lit(span_s * 1_000_000)).alias("span")


def _settles(status: Column) -> Column:
    """The state an anchor settles; null for the statuses that may be leftovers."""
    return (
        F.when(status == "starting", STARTING)
        .when(status == "terminating", TERMINATING)
        .when((status != "running") & ~status.isin(ENDED), OPEN)
    )


def _state_before(settled: Column, ran: Column, ended: Column, number: Column, window: WindowSpec, first: Column) -> Column:
    """State before a numbered row, from what each row settles or releases; ``first`` holds before the first."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.max(F.when(settled.isNotNull(), number * 4 + settled)).over(earlier)
    last_ran = F.coalesce(F.max(F.when(ran, number)).over(earlier), F.lit(0))
    last_ended = F.coalesce(F.max(F.when(ended, number)).over(earlier), F.lit(0))
    state = F.when(anchor.isNull(), first).otherwise(anchor % 4)
    place = F.when(anchor.isNull(), 0).otherwise(F.floor(anchor / 4))
    released = ((state == STARTING) & (last_ran > place)) | ((state == TERMINATING) & (last_ended > place))
    return F.when(released, OPEN).otherwise(state)


def _span_states(rows: DataFrame, carried: DataFrame | None) -> DataFrame:
    """State before each span of each cluster."""
    place = F.struct("ts", "seq")
    settles = _settles(F.col("status"))
    ended = F.col("status").isin(ENDED)
    sums = rows.groupBy("cluster_id", "span").agg(
        F.max(F.when(settles.isNotNull(), F.struct("ts", "seq", settles.alias("state")))).alias("anchor"),
        F.max(F.when(F.col("status") == "running", place)).alias("ran"),
        F.max(F.when(ended, place)).alias("ended"),
    )
    if carried is None:
        sums = sums.withColumn("first_state", F.lit(OPEN))
    else:
        states = carried.select("cluster_id", F.coalesce(_settles(F.col("status")), F.lit(OPEN)).alias("first_state"))
        sums = sums.join(states, "cluster_id", "left").fillna(OPEN, "first_state")
    anchored = F.struct(F.col("anchor.ts").alias("ts"), F.col("anchor.seq").alias("seq"))

    def released_by(name: str) -> Column:
        return F.coalesce(F.col(name) > anchored, F.lit(False))

    state = F.col("anchor.state")
    settled = F.when(
        ((state == STARTING) & released_by("ran")) | ((state == TERMINATING) & released_by("ended")), OPEN
    ).otherwise(state)
    in_order = Window.partitionBy("cluster_id").orderBy("span")
    numbered = sums.select(
        "cluster_id", "span", "first_state",
        settled.alias("settled"),
        (settled.isNull() & F.col("ran").isNotNull()).alias("ran"),
        (settled.isNull() & F.col("ended").isNotNull()).alias("ended"),
        F.row_number().over(in_order).alias("number"),
    )
    before = _state_before(
        F.col("settled"), F.col("ran"), F.col("ended"), F.col("number"), in_order, F.col("first_state")
    )
    return numbered.select("cluster_id", "span", before.alias("span_state"))


def believed_changes(changes: DataFrame, carried: DataFrame | None = None, span_s: int = SPAN_S) -> DataFrame:
    """T5: the status changes that stay, leftovers dropped.

    ``carried`` holds the last believed change of each cluster so far. ``span_s``
    is the length of a span; a task sorts the rows of one cluster in one span.
    The changes are read twice.
    """
    rows = changes.select(*CHANGE, _span(span_s))
    states = _span_states(rows, carried)
    rows = rows.join(states, ["cluster_id", "span"], "left").withColumn("state", F.coalesce("span_state", F.lit(OPEN)))
    in_order = Window.partitionBy("cluster_id", "span").orderBy("ts", "seq")
    status = F.col("status")
    numbered = rows.withColumn("number", F.row_number().over(in_order))
    before = _state_before(
        _settles(status), status == "running", status.isin(ENDED), F.col("number"), in_order, F.col("state")
    )
    judged = numbered.select(*CHANGE, before.alias("before"))
    leftover = ((F.col("before") == STARTING) & status.isin(ENDED)) | (
        (F.col("before") == TERMINATING) & (status == "running")
    )
    return judged.filter(~leftover).select(*CHANGE)


def last_believed(carried: DataFrame, kept: DataFrame) -> DataFrame:
    """The last believed change of each cluster after more changes were kept."""
    newest = F.max(F.struct("ts", "seq", "status")).alias("newest")
    return carried.select(*CHANGE).unionByName(kept.select(*CHANGE)).groupBy("cluster_id").agg(newest).select(
        "cluster_id", "newest.*"
    )
