"""Following pointers and edges to their end: chains by pointer doubling, shortest paths by search from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.lineage import cut


def chain_ends(pointers: DataFrame) -> DataFrame:
    """(id, hops, last, unfinished) of each row of `pointers` (id, next; '' or null for none; ids are unique): how many rows follow it and
    the last of them. A chain that runs into a cycle is unfinished and has no end; hops and last are null then.

    Every round doubles how far each row sees, so a chain of n rows takes log2(n) joins; rows that see their end take no part any more.
    A row that will see an end in a later round has one on its way that sees it in this: a round that ends none leaves cycles only.
    """
    known = pointers.select("id", F.when(F.col("next") != "", F.col("next")).alias("next"))
    there = known.select(F.col("id").alias("ahead"), F.lit(True).alias("there"))
    own = known.join(there, F.col("next") == F.col("ahead"), "left")
    now = cut(own.select("id", F.when(F.col("there"), 1).otherwise(0).cast("long").alias("hops"), F.when(F.col("there"), F.col("next")).otherwise(F.col("id")).alias("last"), F.coalesce("there", F.lit(False)).alias("open")))
    done, now = now.where("not open"), now.where("open")
    left, before = now.count(), None
    while left and left != before:
        far = done.unionByName(now).select(F.col("id").alias("last"), F.col("hops").alias("more"), F.col("last").alias("further"), F.col("open").alias("still"))
        met = cut(now.join(far, "last").select("id", (F.col("hops") + F.col("more")).alias("hops"), F.col("further").alias("last"), F.col("still").alias("open")))
        done, now = done.unionByName(met.where("not open")), met.where("open")
        left, before = now.count(), left
    end = lambda c: F.when(~F.col("open"), F.col(c)).alias(c)
    return done.unionByName(now).select("id", end("hops"), end("last"), F.col("open").alias("unfinished"))


def shortest_paths(own_edges: DataFrame, pairs: DataFrame, most: int = 64) -> DataFrame:
    """(source, target, length, middle) of each of `pairs` (source, target): the undirected distance, and the least node in the middle of
    a shortest path. Both are null where one of the two is no node, where no path leads, or none of up to `most` edges.

    Both ends take turns; a turn joins all pairs' frontiers with the edges once, drops what that side has seen, and is cut. Pairs whose
    sides have met or whose frontier is empty are done. A frontier holds a row per pair and node, however large a hub is.
    """
    both = cut(own_edges.select(F.col("src").alias("node"), F.col("dst").alias("v")).union(own_edges.select("dst", "src")).where("node != v").distinct())
    asked = pairs.select("source", "target").distinct()
    nodes = both.select("node").distinct()
    real = asked.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi")
    key = ["source", "target"]
    seen = [cut(real.select(*key, F.col(end).alias("node"), F.lit(0).alias("d"))) for end in key]
    done = cut(real.where("source = target").select(*key, F.lit(0).alias("length"), F.col("source").alias("middle")))
    depths, side = [0, 0], 0
    while sum(depths) < most:
        d = depths[side]
        frontier = seen[side].where(F.col("d") == d).join(done.select(*key), key, "left_anti")
        ahead = frontier.join(both, "node").select(*key, F.col("v").alias("node")).distinct().join(seen[side].select(*key, "node"), [*key, "node"], "left_anti")
        new = cut(ahead.withColumn("d", F.lit(d + 1)))
        depths[side] = d + 1
        seen[side] = seen[side].unionByName(new)
        other = seen[1 - side].select(*key, "node", F.col("d").alias("e"))
        met = new.join(other, [*key, "node"]).groupBy(*key).agg(F.min(F.struct((F.col("d") + F.col("e")).alias("length"), F.col("node").alias("middle"))).alias("x"))
        found = cut(met.join(done.select(*key), key, "left_anti").select(*key, "x.length", "x.middle"))
        done = done.unionByName(found)
        # a side that found nothing new is exhausted: its open pairs have no path
        if not new.join(done.select(*key), key, "left_anti").limit(1).count():
            break
        side = 1 - side
    return asked.join(done, key, "left")
