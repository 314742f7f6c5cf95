"""Connected components of a links table by alternating star contractions.

Every round is one or two aggregations over the links that are left; nothing
but a counter reaches the driver, and each round's links are cut from their
lineage by a checkpoint in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particula.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); component is the smallest node reachable.

    Nodes without a link are absent. Null ends, loops and repeated links are
    ignored. An empty table gives no rows. The loop ends when a round changes
    nothing, after O(log^2 n) rounds at most.
    """
    edges = cut_lineage(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
