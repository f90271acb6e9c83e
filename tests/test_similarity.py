"""Exact pairs and best overlaps of sets by tiles, against brute force; pairs are not shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import similarity, tiles


def sets(n, words, seed):
    """Sets of one to thirty words in two blocks, with some copies and near copies."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if out and rng.random() < 0.3:
            own = set(rng.choice(out)[2])
            for _ in range(rng.randrange(4)):
                own ^= {f"w{rng.randrange(words)}"}
        else:
            own = {f"w{rng.randrange(words)}" for _ in range(rng.choice((1, 3, 10, 30)))}
        out.append((k, "xy"[k % 2], sorted(own)))
    return out


def jaccard(x, y):
    both = len(set(x) & set(y))
    return both / (len(set(x)) + len(set(y)) - both) if both else 0.0


def shuffled(spark, run):
    """The result of `run` and the rows that its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written(k):
        try:
            return store.lastStageAttempt(k).shuffleWriteRecords()
        except Exception:
            return 0

    first = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(map(written, range(first, spark.sparkContext._jsc.sc().dagScheduler().nextStageId())))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, block string, tokens array<string>")


@pytest.mark.parametrize("least", [0.6, 0.85])
@pytest.mark.parametrize("tile", [300, tiles.TILE])
def test_similar_pairs_are_those_of_brute_force(spark, monkeypatch, least, tile):
    rows = sets(200, 60, 1)
    monkeypatch.setattr(tiles.dealt, "__defaults__", (tile,))
    monkeypatch.setattr(tiles, "TOGETHER", 50)
    firsts = {}
    for k, block, own in rows:
        if own:
            firsts.setdefault((block, tuple(own)), k)
    want = {(a, b): jaccard(x, y) for (s, x), a in firsts.items() for (t, y), b in firsts.items() if s == t and a < b and jaccard(x, y) >= least}
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_sets(similarity.token_sets(frame(spark, rows)), least).collect()}
    assert got == want and want


@pytest.mark.parametrize("tile", [300, tiles.TILE])
def test_best_overlap_is_that_of_brute_force(spark, monkeypatch, tile):
    rows = [*sets(150, 60, 2), (900, "x", []), (901, "x", ["alone"]), (902, "z", ["w1"])]
    pool = [r for r in rows if r[0] % 3]
    monkeypatch.setattr(tiles.dealt, "__defaults__", (tile,))
    monkeypatch.setattr(tiles, "DENSE", 0.05)
    want = {k: max((jaccard(own, other) for q, b, other in pool if b == block and q != k), default=0.0) for k, block, own in rows}
    got = {r["id"]: r["similarity"] for r in similarity.best_overlap(frame(spark, rows), frame(spark, pool)).collect()}
    assert got == want


def test_pairs_with_words_in_common_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "x", sorted({f"w{w}" for w in rng.integers(0, 60, 30)})) for k in range(400)]
    df = frame(spark, rows)
    _, n = shuffled(spark, lambda: similarity.best_overlap(df, df).agg(F.sum("similarity")).collect())
    assert n < 20 * len(rows)
    _, n = shuffled(spark, lambda: similarity.best_earlier(df, 0.5).count())
    assert n < 20 * len(rows)


@pytest.mark.parametrize("least", [0.0, 0.6])
def test_a_set_is_shuffled_once_however_many_tiles_its_own_meets(spark, least):
    rng = np.random.default_rng(4)
    df = frame(spark, [(k, "x", sorted({f"w{w}" for w in rng.integers(0, 2000, 30)})) for k in range(400)])
    own = df.select("block", "id", F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    pairs, n = shuffled(spark, lambda: tiles.dealt(own, least, 1000).count())  # about forty tiles
    assert pairs > 300 and n < 3 * 400


@pytest.mark.parametrize("tile", [300, tiles.TILE])
def test_best_similarity_from_a_least_on_is_that_of_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles.dealt, "__defaults__", (tile,))
    rows = [(*r, r[0] % 4 == 0, r[0] % 3 > 0) for r in [*sets(200, 60, 6), (900, "x", []), (902, "z", ["w1"])]]
    want = {k: max((s for q, b, other, _, kept in rows if kept and b == block and q != k and (s := jaccard(own, other)) >= 0.5), default=0.0) for k, block, own, asked, _ in rows if asked}
    df = spark.createDataFrame(rows, "id long, block string, tokens array<string>, asked boolean, stored boolean")
    got = {r["id"]: r["similarity"] for r in similarity.best_within(df, 0.5).collect()}
    assert got == want and 0 < min(v for v in want.values() if v) < max(want.values())


def test_rule_verdicts_ask_only_for_what_the_other_rules_leave(spark, monkeypatch):
    """every statement was compared with all of its project, though the duplicate rule comes last and wants 0.6."""
    from memlake.plans.queries import QUERIES

    seen, sf = [], "/root/testdata/sf0.01"
    inner = similarity.best_within
    monkeypatch.setattr(similarity, "best_within", lambda df, *a: (seen.append(df.where("asked").count()), inner(df, *a))[1])
    verdicts = {r["verdict"]: r["count"] for r in QUERIES["rule_verdicts"](spark, sf).groupBy("verdict").count().collect()}
    assert seen == [verdicts.get("", 0) + verdicts.get("DUPLICATE", 0)] and sum(verdicts.values()) > 2 * seen[0]
