"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are hung on the least of them. Edges lead from the higher to the lower node."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for each node that has an edge to another; component: its least reachable node.

    Edges lead either way, may repeat, and may have nulls (left out) or loops (left out). Empty in, empty out. Nodes are of any type
    that has an order. No node's neighbours meet in one task: minima are combined before they are shuffled, and joins on a node of
    high degree are split by adaptive execution. Each round is written to the shared folder, and the one before it removed; their number
    grows with the logarithm.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = written(now.where("u <> v").distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        before, now = now, written(_small_star(_large_star(now)), "edges")
        discard(before)
        digest = _digest(now)
        if digest == seen:
            break
        seen = digest
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rooted.union(rooted.select(F.col("component").alias("node"), "component").distinct())
