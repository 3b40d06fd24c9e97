"""Spells of activity, and when a cluster fell silent.

Two heartbeats at most a gap apart belong to one spell. Heartbeats of one window of the gap's length are always that
near to each other, so they are first combined to one row per window, before they are moved; spells are made of these rows. A
cluster with very many heartbeats costs as many rows as it has windows.

A spell is over when the newest heartbeat of any cluster is at least a gap, and a delay, later than its last one. Spells
that are not over are carried to the next batch; a heartbeat that can only belong to a spell that is over is late and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPELL = "struct<active_from: timestamp_ntz, last_heartbeat: timestamp_ntz, heartbeats: bigint>"
OPEN_SCHEMA = f"cluster_id bigint, spells array<{SPELL}>"
IDLE_SCHEMA = (
    "cluster_id bigint, active_from timestamp_ntz, last_heartbeat timestamp_ntz, idle_from timestamp_ntz, heartbeats bigint"
)
_PIECE = ["active_from", "last_heartbeat", "heartbeats"]


def after(ts: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), ts)


def windows(status: DataFrame, gap_s: int) -> DataFrame:
    """First and last heartbeat and their number, per cluster and window of the gap's length; rows without a time are passed over."""
    window = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(gap_s * 1_000_000)).alias("window")
    heard = status.where("ts IS NOT NULL").groupBy("cluster_id", window)
    return heard.agg(
        F.min("ts").alias("active_from"), F.max("ts").alias("last_heartbeat"), F.count(F.lit(1)).alias("heartbeats")
    ).drop("window")


def spells(pieces: DataFrame, gap_s: int) -> DataFrame:
    """The spells (cluster_id, active_from, last_heartbeat, heartbeats) of pieces of the same columns."""
    in_order = Window.partitionBy("cluster_id").orderBy("active_from", "last_heartbeat")
    reach = F.max("last_heartbeat").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("active_from") > after(reach, gap_s))).cast("int")
    numbered = pieces.withColumn("fresh", fresh)
    numbered = numbered.withColumn("spell", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("cluster_id", "spell").agg(
        F.min("active_from").alias("active_from"), F.max("last_heartbeat").alias("last_heartbeat"), F.sum("heartbeats").alias("heartbeats")
    )
    return merged.select("cluster_id", *_PIECE)


def opened(carried: DataFrame) -> DataFrame:
    """The spells that are carried, one per row."""
    return carried.select("cluster_id", F.explode("spells").alias("spell")).select("cluster_id", "spell.*")


def is_over(clock: Column, gap_s: int, delay_s: int) -> Column:
    return after(F.col("last_heartbeat"), gap_s + delay_s) <= clock


def idle_rows(over: DataFrame, gap_s: int) -> DataFrame:
    """A row each time a cluster has been silent for longer than the gap."""
    idle_from = after(F.col("last_heartbeat"), gap_s).alias("idle_from")
    return over.select("cluster_id", "active_from", "last_heartbeat", idle_from, "heartbeats")


def carried_on(carried: DataFrame, judged: DataFrame) -> DataFrame:
    """Clusters whose open spells changed, with those that are open now; none for a cluster that fell silent.

    ``judged`` has the spells of all clusters with open spells or new heartbeats, and whether each is ``over``.
    """
    piece = F.struct(*_PIECE)
    now = judged.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.when(~F.col("over"), piece))).alias("spells"))
    before = carried.select(F.col("cluster_id").alias("known"), F.col("spells").alias("had"))
    joined = now.join(before, now["cluster_id"].eqNullSafe(before["known"]), "left")
    changed = ~F.col("spells").eqNullSafe(F.coalesce("had", F.array().cast(f"array<{SPELL}>")))
    return joined.where(changed).select("cluster_id", "spells")
