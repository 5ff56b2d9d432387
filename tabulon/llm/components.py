"""Connected components of an edge table, by alternating large-star and small-star steps.

Links and labels stay in tables; only two counts a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import release, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: each node's neighbours are linked to the least of them and itself. The small
    step takes smaller neighbours, the large step links the larger ones."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(least, "u")
    linked = linked.union(least.select("u", F.col("u").alias("v"), "m")) if small else linked.filter("v > u")
    return linked.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node that an edge (a, b) has; component is its least node.

    Each round ends in a written table. Self-links don't count; nulls must not occur. Edges
    that are stars of their least nodes already are done after one round.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        before, edges = edges, written(_star(_star(edges, small=False), small=True), "edges")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
