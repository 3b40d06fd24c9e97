"""Connected components of links between documents, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def followed(parents: DataFrame) -> DataFrame:
    """The root each node reaches in a forest given as (node, parent); doubles the distance each round.

    Nodes without a parent row are roots. The graph must have no cycle.
    """
    links = saved(parents.select("node", "parent"), "forest")
    while True:
        above = links.select(F.col("node").alias("middle"), F.col("parent").alias("above"))
        joined = links.join(above, links["parent"] == above["middle"], "left")
        moved = joined.select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        moved = saved(moved, "forest")
        if moved.where("moved").limit(1).count() == 0:
            return moved.select("node", F.col("parent").alias("root"))
        links = moved.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of undirected links (a, b).

    Each round every component looks for the smallest label beside it; labels point at smaller ones, pointers are
    followed to their ends, and links inside a component go. Components at least halve, so rounds are few.
    """
    edges = saved(links.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = saved(nodes.withColumn("label", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
        roots = followed(least.select(F.col("a").alias("node"), F.col("b").alias("parent")))
        roots = roots.select(F.col("node").alias("old"), F.col("root").alias("new"))
        joined = labels.join(roots, labels["label"] == roots["old"], "left")
        labels = saved(joined.select("node", F.coalesce("new", "label").alias("label")), "labels")
        left = edges.join(roots, edges["a"] == roots["old"], "left").select(F.coalesce("new", "a").alias("a"), "b")
        right = left.join(roots, left["b"] == roots["old"], "left").select("a", F.coalesce("new", "b").alias("b"))
        edges = saved(right.where("a <> b").distinct(), "edges")
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
