"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each directed pair with the least vertex around u. The least is aggregated before it is joined, so that a hub's pairs
    are only joined, where Spark may split them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every vertex of `edges` (a long, b long); a component is named by its least vertex.

    Repeated edges, self-loops and an empty table are fine: a vertex with only self-loops is its own component, no edges give no rows.
    Every round is written to the checkpoint folder. Only a count and a checksum reach the driver.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
        if not mark[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _stars(large)
        now = cut(small.select(F.col("v").alias("u"), "m").union(small.select("u", "m")).where("u != m").distinct().select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    return named.union(loops.distinct().join(named, "node", "left_anti").select("node", F.col("node").alias("component")))
