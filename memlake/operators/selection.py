"""Choosing what to show: bootstrap ranking, greedy selection without near repeats, running budgets, digests and recall probes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring
from memlake.functions.text import capture_reason, stems, token_estimate, tokens
from memlake.lineage import cut

from .search import active, in_scope


def bootstrap_rank(records: DataFrame, query: tuple[str, ...], project_id: str, as_of: int, k: int = 15) -> DataFrame:
    """The best active records in scope: the project's own first, then by type, quality, freshness and the share of `query` tokens they hold."""
    asked = F.array(*map(F.lit, query)) if query else F.array().cast("array<string>")
    priority, fresh = scoring.looked_up(F.col("type"), scoring.PRIORITY, 0.5), scoring.bootstrap_freshness(F.col("at_s"), as_of)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("quality_score", "confidence", F.lit(0.5))))
    held = F.array_distinct(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) > 1))
    score = priority * 0.30 + quality * 0.30 + fresh * 0.15 + F.size(F.array_intersect(asked, held)) / len(query) * 0.25 if query else priority * 0.4 + quality * 0.4 + fresh * 0.2
    tier = F.when(F.col("project_id") == project_id, 0).otherwise(1)
    rated = records.where(in_scope(project_id) & active()).select("memory_id", "content", tier.alias("tier"), F.round(score, 9).alias("score"))
    return rated.orderBy("tier", F.desc("score"), "memory_id").limit(k)


def select_distinct(ranked: DataFrame, limit: int = 12, least: float = 0.6, stale: DataFrame | None = None) -> DataFrame:
    """`ranked` (a shortlist: memory_id, content, tier, score) with the `place` at which each record was looked at and the reason it is left
    out, '' if it is chosen. Records of `stale` (memory_id) come behind all others.

    The choice is sequential: while there are slots, a record goes if its stems overlap any chosen one's by `least`. It runs in one task
    over the shortlist, whose length the ranking before it bounds.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["stale", "tier", "score", "memory_id"], ascending=[True, True, False, True])
        chosen: list[tuple[str, set]] = []
        reasons = []
        for name, own in zip(frame["memory_id"], map(set, frame["stems"]), strict=True):
            near = None if len(chosen) == limit else next((other for other, s in chosen if own and s and len(own & s) / len(own | s) >= least), None)
            if len(chosen) == limit:
                reasons.append("SLOT_LIMIT")
            elif near is not None:
                reasons.append(f"NEAR_DUPLICATE_OF:{near}")
            else:
                chosen.append((name, own))
                reasons.append("")
        return pd.DataFrame({"memory_id": frame["memory_id"], "place": range(len(frame)), "reason": reasons})

    marked = ranked.withColumn("stale", F.lit(False)) if stale is None else ranked.join(stale.select("memory_id", F.lit(True).alias("stale")).distinct(), "memory_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    own = marked.select("memory_id", "tier", "score", "stale", stems(F.col("content")).alias("stems"), F.lit(0).alias("one"))
    return own.groupBy("one").applyInPandas(choose, "memory_id string, place int, reason string")


def explain_bootstrap(records: DataFrame, query: tuple[str, ...], project_id: str, as_of: int, stale: DataFrame, budget: int = 3000, pool: int = 15, slots: int = 12, overhead: int = 4, human_approval: bool = False) -> DataFrame:
    """(memory_id, reason, stale_candidate) of every active record in scope: DELIVERED, or where it stopped: NOT_APPROVED (if people must
    approve), SAFETY_FILTERED, BELOW_POOL, NEAR_DUPLICATE_OF:id, SLOT_LIMIT, TOKEN_BUDGET.

    The first `pool` records by rank make the pool; those that are filtered leave their place empty. What is chosen is cut from its end
    until its cautious token estimate, of its bytes and `overhead` a record, fits the budget.
    """
    seen = records.where(in_scope(project_id) & active())
    first = bootstrap_rank(records, query, project_id, as_of, pool)
    stopped = F.when(F.lit(human_approval) & ~F.coalesce("is_approved", F.lit(True)), "NOT_APPROVED").when(capture_reason(F.col("content")) != "", "SAFETY_FILTERED")
    rated = seen.select("memory_id", stopped.alias("stopped"))
    marked = cut(first.join(rated, "memory_id"))
    chosen = select_distinct(marked.where("stopped is null"), slots, stale=stale).join(marked.select("memory_id", F.octet_length("content").alias("n")), "memory_id")
    order = Window.partitionBy(F.lit(0)).orderBy("place")  # a shortlist
    used = F.ceil(F.sum(F.when(F.col("reason") == "", F.col("n") + overhead).otherwise(0)).over(order) / 3) + 1
    told = chosen.withColumn("used", used).select("memory_id", F.when(F.col("reason") != "", F.col("reason")).when(F.col("used") > budget, "TOKEN_BUDGET").otherwise("DELIVERED").alias("chosen"))
    flags = stale.select("memory_id", F.lit(True).alias("flagged")).distinct()
    met = rated.join(F.broadcast(told), "memory_id", "left").join(flags, "memory_id", "left")
    return met.select("memory_id", F.coalesce("stopped", "chosen", F.lit("BELOW_POOL")).alias("reason"), F.coalesce("flagged", F.lit(False)).alias("stale_candidate"))


def within_budget(ranked: DataFrame, budget: int, overhead: int = 4) -> DataFrame:
    """The longest prefix of a shortlist (memory_id, content, tier, score) whose estimated tokens stay within `budget`."""
    order = Window.partitionBy(F.lit(0)).orderBy("tier", F.desc("score"), "memory_id")  # a shortlist
    return ranked.withColumn("used", F.sum(token_estimate(F.col("content")) + overhead).over(order)).where(F.col("used") <= budget).select("memory_id", "used")


def digest(records: DataFrame, k: int = 5, least: float = 0.6, group: int = 200) -> DataFrame:
    """(type, memory_id, rank): per type the best k records, none of which overlaps a better one's tokens by `least`.

    A round looks at the `group` best of each type by a window that keeps no more than those. Types that are left with fewer than k
    records go on with what lies behind and overlaps nothing chosen, round by round until they have k or are used up, so a type led by any
    number of near copies is looked at whole. Only the chosen ids, k a type at most, reach the driver. Records without tokens overlap none.
    """
    score = F.round(scoring.rank_score(F.col("quality_score"), F.col("confidence")), 9)
    rated = records.select("type", "memory_id", score.alias("score"), "content")
    order = Window.partitionBy("type").orderBy(F.desc("score"), "memory_id")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        kept: list[tuple[str, set]] = []
        for name, own in zip(frame["memory_id"], map(set, frame["tokens"]), strict=True):
            if all(not own or not s or len(own & s) / len(own | s) < least for _, s in kept):
                kept.append((name, own))
            if len(kept) == k:
                break
        last = frame.iloc[-1]
        return pd.DataFrame({"type": last["type"], "memory_id": [n for n, _ in kept], "last": last["memory_id"], "last_score": last["score"], "full": len(frame) == group})

    chosen: dict[str | None, list[str]] = {}
    left = rated
    while True:
        best = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= group).select("type", "memory_id", "score", "r", tokens(F.col("content")).alias("tokens"))
        ends = {}
        for row in best.groupBy("type").applyInPandas(choose, "type string, memory_id string, last string, last_score double, full boolean").collect():
            own = chosen.setdefault(row["type"], [])
            if len(own) < k:
                own.append(row["memory_id"])
            if row["full"]:
                ends[row["type"]] = (row["last_score"], row["last"])
        ends = {kind: end for kind, end in ends.items() if len(chosen[kind]) < k}
        if not ends:
            break
        behind = F.lit(False)
        for kind, (end, name) in ends.items():
            after = (F.col("score") < end) | F.col("score").isNull() | ((F.col("score") == end) & (F.col("memory_id") > name))
            behind = behind | (F.col("type").eqNullSafe(kind) & (after if end is not None and end == end else F.col("score").isNull() & (F.col("memory_id") > name)))
        ids = [name for kind in ends for name in chosen[kind]]
        near = rated.where(F.col("memory_id").isin(ids)).select(F.col("type").alias("near_type"), tokens(F.col("content")).alias("near"))
        x = tokens(F.col("content"))
        overlap = F.size(F.array_intersect(x, "near")) >= least * F.size(F.array_union(x, "near"))
        left = rated.where(behind).join(F.broadcast(near), F.col("type").eqNullSafe(F.col("near_type")) & (F.size("near") > 0) & (F.size(x) > 0) & overlap, "left_anti")
    found = [(kind, name, place) for kind, own in chosen.items() for place, name in enumerate(own, 1)]
    return records.sparkSession.createDataFrame(found, "type string, memory_id string, rank int")


def recall_probe(records: DataFrame, questions: list[tuple[str, list[list[str]]]]) -> DataFrame:
    """(question, status, carriers): IN_MEMORY if an active record holds a term of every group, NOT_DELIVERED if only other records do,
    NOT_IN_MEMORY if none. `questions` is a short list, so each is a column of one pass."""
    low = F.lower("content")

    def holds(groups: list[list[str]]):
        every = F.lit(True)
        for g in groups:
            one = F.lit(False)
            for term in g:
                one = one | low.contains(term.lower())
            every = every & one
        return every

    n = records.agg(*[F.count_if(holds(g) & active()).alias(f"a{i}") for i, (_, g) in enumerate(questions)], *[F.count_if(holds(g)).alias(f"n{i}") for i, (_, g) in enumerate(questions)])
    rows = F.array(*[F.struct(F.lit(q).alias("question"), F.when(F.col(f"a{i}") > 0, "IN_MEMORY").when(F.col(f"n{i}") > 0, "NOT_DELIVERED").otherwise("NOT_IN_MEMORY").alias("status"), F.col(f"a{i}").alias("carriers")) for i, (q, _) in enumerate(questions)])
    return n.select(F.inline(rows))
