"""The exact cosine join over small tiles, and retiring in rounds against retiring pair after pair."""

import random

import numpy as np
import pytest

from memlake.operators import audit


@pytest.mark.parametrize("tile", [3, 2048])
def test_pairs_are_the_full_product(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    rows = [(i, "ab"[i % 2], [float(c) for c in base[i % 12] + rng.normal(size=24) * rng.choice([0, 0.1, 0.5])]) for i in range(80)] + [(90, "a", [0.0] * 24), (91, "a", None)]
    df = spark.createDataFrame(rows, "id long, block string, embedding array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in audit.cosine_pairs(df, 0.8, tile).collect()}
    first = {}
    for i, block, v in rows[:80]:
        first.setdefault((block, tuple(v)), i)
    want = {(first[block, tuple(v)], i): 1.0 for i, block, v in rows[:80] if first[block, tuple(v)] != i}
    units = {i: (b, np.array(v) / np.linalg.norm(v)) for (b, v), i in first.items()}
    for a in sorted(units):
        for b in sorted(units):
            if a < b and units[a][0] == units[b][0] and units[a][1] @ units[b][1] >= 0.8:
                want[a, b] = units[a][1] @ units[b][1]
    assert got.keys() == want.keys() and len(want) > 40 and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_rounds_are_one_after_the_other(spark):
    rng = random.Random(8)
    ids = range(26)
    standing = {i: rng.randrange(4) for i in ids}
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(26), rng.randrange(26)) for _ in range(60)) if a != b})
    rated = [(a, b, rng.choice([0.96, 0.97, 1.0])) for a, b in pairs]
    carriers = [(f"q{k}", "p", rng.randrange(26)) for k in range(9) for _ in range(rng.choice([1, 2, 2, 3]))]
    carriers = sorted(set(carriers))
    gone, want = set(), []
    for a, b, s in sorted(rated, key=lambda p: (-p[2], p[0], p[1])):
        if {a, b} & gone:
            continue
        keep, drop = (a, b) if standing[a] >= standing[b] else (b, a)
        answers = {q: [i for qq, _, i in carriers if qq == q and i not in gone] for q, _, _ in carriers}
        last = {x[0] for x in answers.values() if len(x) == 1}
        if drop in last:
            keep, drop = drop, keep
        if drop in last:
            want.append(("DUPLICATE_PROTECTED", drop, keep, s))
            continue
        gone.add(drop)
        want.append(("RETIRED", drop, keep, s))
    got = audit.retirements(
        spark.createDataFrame(rated, "a long, b long, similarity double"),
        spark.createDataFrame([(i, (n,)) for i, n in standing.items()], "id long, standing struct<n:int>"),
        spark.createDataFrame(carriers, "question string, project_id string, id long"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {k for k, *_ in want} == {"RETIRED", "DUPLICATE_PROTECTED"}
