"""Connected components by alternating large-star and small-star.

Large-star: every node sends its larger neighbours to its smallest one (itself counted). Small-star: every node sends
its smaller neighbours and itself to the smallest of them. Both keep components whole and shorten paths; when neither
changes an edge, every node hangs on its component's smallest node. Each step is a pre-aggregated minimum and a join, so
a node with very many neighbours is split like any other skewed key; each round is written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` from the larger node ``u`` to the smaller ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node but each component's smallest.

    ``edges``: ``u`` and ``v``; loops, repeated and reversed edges and none at all are fine.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before = now.agg(mark).first()[0]
    while before[0]:
        now = stage(_small_star(_large_star(now)))
        after = now.agg(mark).first()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
