"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.frames import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the not larger) neighbours of every node on its smallest neighbour."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (u, v) reaches.

    Every step keeps the components; the edge list becomes stars after O(log**2) steps, and a step
    that changes nothing ends the loop. Edges are turned so that u > v. Nodes without edges don't
    occur. Hot nodes only meet partial minima.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _mark(now)
    while True:
        now = durable(_star(_star(now, True), False), rows=seen["n"])  # a step adds no edges
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    leaf = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaf.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(leaf.select("node"), "node", "left_anti"))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
