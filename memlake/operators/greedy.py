"""Greedy choices over pools of any size, in a few distributed rounds each: under a budget, to cover, and by tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.lineage import cut

#: What task-aware selection may take.
MAX_ITEMS, MAX_TOKENS, MAX_BYTES = 5, 1024, 8192


def byte_budget(tokens: int, most_bytes: int = MAX_BYTES) -> int:
    """The bytes whose cautious token estimate, a third of them and one, stays within `tokens`."""
    return min(most_bytes, max(0, 3 * (min(tokens, MAX_TOKENS) - 1)))


def within_budget(pool: DataFrame, order: list[Column], cost: Column, budget: int, items: int = MAX_ITEMS, id_col: str = "memory_id") -> DataFrame:
    """(id, place, cost): from the best on, every row that still fits beside those taken, up to `items` rows; a row that does not fit is
    passed over and later ones are tried. `order` must end in something unique.

    Equal to going through the whole pool: a round looks at the best rows behind the last one looked at that fit what is left, no more
    of them than may still be taken, and takes at least the first of them.
    """
    ranked = cut(pool.select(F.col(id_col).alias("id"), cost.cast("long").alias("cost"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("key")))
    taken, left = [], budget
    behind = ranked
    while len(taken) < items:
        rows = behind.where(F.col("cost") <= left).orderBy("key").limit(items - len(taken)).collect()
        if not rows:
            break
        for r in rows:
            if r["cost"] <= left:
                taken.append((r["id"], len(taken) + 1, r["cost"]))
                left -= r["cost"]
        last = rows[-1]["id"]
        behind = ranked.where(F.col("key") > ranked.where(F.col("id") == last).select(F.max("key")).scalar())
    return pool.sparkSession.createDataFrame(taken, f"id {dict(pool.dtypes)[id_col]}, place int, cost long")


def greedy_cover(items: DataFrame, groups: list[Column], id_col: str = "id") -> DataFrame:
    """(id, place, covers): the items chosen so that together they hold every group: always the one that holds most of what is left, the
    first (by id) of equals; no rows if some group is held by none. `groups` are conditions, at most 62.

    Items are reduced to the first of each set of groups, so a round aggregates at most one row a set.
    """
    mask = F.lit(0).cast("long")
    for k, holds in enumerate(groups):
        mask = mask + F.when(holds, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    sets = cut(items.select(F.col(id_col).alias("id"), mask.alias("mask")).where("mask != 0").groupBy("mask").agg(F.min("id").alias("id")))
    left, chosen = (1 << len(groups)) - 1, []
    while left:
        hits = F.bit_count(F.col("mask").bitwiseAND(F.lit(left)))
        best = sets.select(hits.alias("hits"), "id", "mask").where("hits > 0").orderBy(F.desc("hits"), "id").limit(1).collect()
        if not best:
            return items.sparkSession.createDataFrame([], f"id {dict(items.dtypes)[id_col]}, place int, covers int")
        chosen.append((best[0]["id"], len(chosen) + 1, best[0]["hits"]))
        left &= ~best[0]["mask"]
    return items.sparkSession.createDataFrame(chosen, f"id {dict(items.dtypes)[id_col]}, place int, covers int")


def tiered(candidates: DataFrame, quotas: list[int], order: list[Column], limit: int) -> DataFrame:
    """`candidates` (with `tier` from 0) with their `place` in a shortlist of `limit`: each tier in turn gives its best rows up to its
    quota and what earlier tiers left of theirs; what is free after the last goes to the best of all that are left. `order` must end in
    something unique.

    A tier's rows are ranked only as far as the limit, by the hash of a row first, so no tier is ordered in one task.
    """
    spread = F.pmod(F.hash(*candidates.columns), F.lit(64))
    near = candidates.withColumn("r", F.row_number().over(Window.partitionBy("tier", spread).orderBy(*order))).where(F.col("r") <= limit)
    ranked = cut(near.withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy(*order))).where(F.col("r") <= limit))
    have = {r["tier"]: r["n"] for r in ranked.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    grant, spare = {}, 0
    for tier, quota in enumerate(quotas):
        grant[tier] = min(have.get(tier, 0), quota + spare, limit - sum(grant.values()))
        spare += quota - grant[tier]
    granted = F.lit(0)
    for tier, n in grant.items():
        granted = F.when(F.col("tier") == tier, n).otherwise(granted)
    first = F.col("r") <= granted
    place = F.row_number().over(Window.orderBy(F.when(first, F.col("tier")).otherwise(len(quotas)), *order))
    return ranked.withColumn("by_quota", first).withColumn("place", place).where(F.col("place") <= limit).drop("r")
