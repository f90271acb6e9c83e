"""Greedy choices, shortlists, paths, chains and subject entities against plain sequential versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from memlake.operators import greedy, paths, subjects


@pytest.mark.parametrize("seed", [1, 2])
def test_budget_is_plain_greedy(spark, seed):
    rng = random.Random(seed)
    pool = [(f"m{i:03}", rng.choice([0.1, 0.5, 0.9]), rng.choice([5, 30, 60, 90, 400])) for i in range(120)]
    for budget, items in ((200, 5), (61, 3), (4, 5), (10_000, 8)):
        want, left = [], budget
        for name, _, cost in sorted(pool, key=lambda r: (-r[1], r[0])):
            if len(want) < items and cost <= left:
                want.append((name, len(want) + 1, cost))
                left -= cost
        df = spark.createDataFrame(pool, "memory_id string, score double, cost int")
        got = greedy.within_budget(df, [-F.col("score"), F.col("memory_id")], F.col("cost"), budget, items)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_cover_is_plain_greedy(spark):
    rng = random.Random(3)
    items = [(i, "".join(c for c in "abcdefg" if rng.random() < 0.3)) for i in range(40)]
    df = spark.createDataFrame(items, "id long, text string")
    groups = [F.col("text").contains(c) for c in "abcdefg"]
    left, want = set("abcdefg"), []
    while left:
        best = max(items, key=lambda r: (len(left & set(r[1])), -r[0]))
        want.append((best[0], len(want) + 1, len(left & set(best[1]))))
        left -= set(best[1])
    assert [tuple(r) for r in greedy.greedy_cover(df, groups).orderBy("place").collect()] == want
    assert greedy.greedy_cover(df, [*groups, F.col("text").contains("z")]).count() == 0


@pytest.mark.parametrize("sizes", [(3, 9, 0), (0, 0, 5), (10, 10, 10), (0, 0, 0), (1, 0, 30)])
def test_unused_quota_moves_on(spark, sizes):
    rows = [(f"t{t}_{i:02}", t, float(-i)) for t, n in enumerate(sizes) for i in range(n)]
    quotas, limit = [4, 4, 4], 10
    first, spare = [], 0
    for t, q in enumerate(quotas):
        own = [r for r in rows if r[1] == t][: min(q + spare, limit - len(first))]
        spare += q - len(own)
        first += own
    rest = sorted((r for r in rows if r not in first), key=lambda r: (-r[2], r[0]))
    want = [r[0] for r in first + rest][:limit]
    df = spark.createDataFrame(rows, "id string, tier int, score double")
    got = greedy.tiered(df, quotas, [F.desc("score"), F.asc("id")], limit).orderBy("place").collect()
    assert [r["id"] for r in got] == want


def test_a_long_chain_and_cycles(spark):
    rows = [(f"c{i}", f"c{i + 1}" if i < 999 else "") for i in range(1000)] + [("p", "q"), ("q", "p"), ("s", "s"), ("into", "p"), ("x", "gone"), ("n", None)]
    got = {r["id"]: tuple(r)[1:] for r in paths.chain_ends(spark.createDataFrame(rows, "id string, next string")).collect()}
    assert len(got) == len(rows)
    assert got["c0"] == (999, "c999", False) and got["c998"] == (1, "c999", False) and got["c999"] == (0, "c999", False)
    assert got["x"] == (0, "x", False) and got["n"] == (0, "n", False)
    assert all(got[k] == (None, None, True) for k in ("p", "q", "s", "into"))


def test_paths_are_breadth_first(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(55)] + [("hub", f"n{i}") for i in range(0, 60, 9)]
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)

    def length(a, b):
        if a not in around or b not in around:
            return None
        seen, queue = {a: 0}, deque([a])
        while queue:
            u = queue.popleft()
            for v in around[u] - seen.keys():
                seen[v] = seen[u] + 1
                queue.append(v)
        return seen.get(b)

    pairs = [(f"n{rng.randrange(64)}", f"n{rng.randrange(64)}") for _ in range(40)]
    got = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "source string, target string")).collect()
    known = {a for a, b in edges if a == b and around[a] == {a}}  # a node with a loop alone is no end of a path here
    for r in got:
        want = None if {r["source"], r["target"]} & known else length(r["source"], r["target"])
        assert r["length"] == want, r
        assert r["middle"] is None or length(r["source"], r["middle"]) + length(r["middle"], r["target"]) == r["length"]


def test_subjects(spark):
    entities = [("e1", "Redis", "TECHNOLOGY"), ("e2", "redis cache", "TECHNOLOGY"), ("e3", "we use Redis Cache now", "DECISION"), ("e4", "mem0", "TECHNOLOGY"), ("e5", "C", "TECHNOLOGY"), ("e6", "", "PHASE")]
    asked = [(1, "What is connected to the Redis cache?"), (2, "mem0"), (3, "zebra"), (4, ""), (5, "is C fast")]
    got = subjects.subject_entities(spark.createDataFrame(asked, "question long, text string"), spark.createDataFrame(entities, "id string, name string, type string"))
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["question"], r["rank"])):
        found.setdefault(r["question"], []).append((r["id"], r["exact"]))
    assert found == {1: [("e2", True), ("e1", True), ("e3", False)], 2: [("e4", True)], 5: [("e5", True), ("e2", False), ("e3", False)]}


def test_rings_end_the_search_for_ends(spark, monkeypatch):
    """A ring among a thousand short chains takes the rounds of the longest chain, not those of a chain of all rows."""
    rounds = []
    monkeypatch.setattr(paths, "cut", lambda df: rounds.append(1) or df.localCheckpoint())
    rows = [(f"{k}", f"{k - 1}" if k % 4 else None) for k in range(1000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    got = {r["id"]: (r["hops"], r["last"], r["unfinished"]) for r in paths.chain_ends(spark.createDataFrame(rows, "id string, next string")).collect()}
    assert got["7"] == (3, "4", False) and got["8"] == (0, "8", False) and all(got[x] == (None, None, True) for x in "abcd")
    assert len(got) == len(rows) and len(rounds) <= 5
