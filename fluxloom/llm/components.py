"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` but the roots; a root is its component's smallest node.

    Every step aggregates per node before it joins, so a hub costs no more than its edges; the
    rounds grow with the logarithm of the longest path. Loops and repeated edges are ignored.
    """
    pair = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, mark = _round(edges.where("a <> b").select(*pair).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nodes = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, seen = _round(nodes.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if seen == mark:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, mark = after, seen


def _round(edges: DataFrame):
    edges = settle(edges)
    return edges, edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
