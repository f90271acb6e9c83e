import math
import random

import numpy as np
import pytest

from memlake.llm import whitening

TABLE = "vec_id long, embedding array<float>, label int, x string, n int"


def brute(rows, components=4):
    """Per row: exact n, S, deviation, and whitened up to the sign of each component."""
    xs = {i: [math.floor(float(np.float32(c)) * 256) for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(x) for x in xs.values()}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for i, x in xs.items():
        w = (np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), w, values[order] / values.sum())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12)) * np.linspace(3, 0.3, 12)
    found = [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(900, 12)) @ mix + 7).astype(np.float32))]
    return found + [(1000 + i, found[3][1]) for i in range(400)]


def test_whitened_is_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    odd = [(2000, None), (2001, [1.0] * 11 + [float("nan")]), (2002, [float("inf")] + [0.0] * 11), (2003, [None] + [0.0] * 11), (2004, []), (2005, [1.0] * 5), (2006, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + odd], TABLE).repartition(11)
    got = whitening.whiten(df).collect()
    want = brute(rows)
    assert len(got) == 4 * len(rows)
    flips = {}
    for r in sorted(got, key=lambda r: (r["vec_id"], r["component"])):
        n, deviation, w, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        if k not in flips and abs(w[k]) > 0.1:
            flips[k] = np.sign(w[k] * r["whitened"])
        assert abs(r["whitened"] * flips.get(k, 1) - w[k]) < 1e-8 or k not in flips
        assert abs(r["explained"] - explained[k]) < 1e-10 and r["identity_error"] < 1e-9


def test_merges_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-10**6, 10**6, (500, 7)) + np.arange(7) * 10**7
    whole = whitening.State.of(x)
    parts = [whitening.State.of(p) for p in np.split(x, [1, 2, 5, 80, 300])]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == 500 and merged.sums == [int(s) for s in x.sum(0)]
    assert np.allclose(merged.singular, whole.singular, rtol=1e-12)
    assert np.allclose(np.abs((merged.vectors * whole.vectors).sum(1)), 1, atol=1e-9)


def test_flat_and_few_dimensions(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 2.0], 0, "", 0) for i in range(9)] + [(None, [0.0, 2.0], 0, "", 0)], TABLE)
    got = whitening.whiten(df).collect()
    assert len(got) == 20 and {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {3}
    assert all(r["whitened"] == 0.0 and r["explained"] == 0.0 for r in got if r["component"] == 2)
    assert all(r["identity_error"] < 1e-12 for r in got)


def test_one_vector_and_none(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [0.5] * 6, 0, "", 0)] * 3, TABLE)).collect()
    assert len(got) == 12 and all((r["n"], r["deviation"], r["whitened"], r["explained"]) == (1, 0, 0.0, 0.0) for r in got)
    assert whitening.whiten(spark.createDataFrame([], TABLE)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "", 0)], TABLE)).collect() == []


def test_deviation_is_exact_or_null(spark):
    rng = random.Random(2)
    big = [(i, [rng.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in big] + [(99, [3.0e38, 0.0, 0.0], 0, "", 0)], TABLE)
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert got[99]["deviation"] is None and got[0]["n"] == 41
    alone = whitening.whiten(spark.createDataFrame([(i, v, 0, "", 0) for i, v in big], TABLE)).collect()
    want = brute(big, 3)
    assert all(r["deviation"] == (want[r["vec_id"]][1] if want[r["vec_id"]][1] < 1 << 63 else None) for r in alone)
