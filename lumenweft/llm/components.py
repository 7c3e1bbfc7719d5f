"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import materialize


def _star(edges: DataFrame, name: str) -> DataFrame:
    """Every neighbour and the node itself point at the node's smallest neighbour (or itself).

    The minima are stored, so that they meet the edges in a join by itself: a node with very many edges is a skewed part of
    that, which Spark cuts up.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(materialize(least, name), "u")


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars: no point has two centres, and no centre is a point of another star."""
    points = edges.groupBy("u").agg(F.count("*").alias("n"))
    if not points.where("n > 1").isEmpty():
        return False
    return edges.select("v").distinct().join(points.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), component being its smallest reachable node.

    Each round keeps connectivity and shortens paths; rounds stop when the edges are stars around smallest nodes, and there
    are none if they are stars to begin with. Nothing but that answer reaches the driver. Self-loops, repeated edges and an
    empty table are fine; nodes without edges are absent.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _settled(now):
        large = _star(now, name).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name)
        # Small star: of each node and its smaller neighbours, all but the smallest point at the smallest. After a large star
        # a node has no more of them than it had neighbours that differ in their minimum.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
