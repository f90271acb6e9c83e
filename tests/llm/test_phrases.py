import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from memlake.llm import phrases

TABLE = "doc_id long, text string, lang string, n long, score double, phrase string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, best=2000):
    counts, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in (1, 2, 3):
                c.update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, c in counts.items():
        rows = []
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(2)) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "New", "york", "city", "é", "É", "ß", "x y", " ", "a" * 300, "\x00", "\x1c", "zz"]
    found = []
    for i in range(700):
        words = [rng.choice(vocabulary) if rng.random() < 0.5 else f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randrange(0, 60))]
        found.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    return found + [(None, "en"), ("", None), (" \t.\n", "de"), ("new york " * 3000, "en"), ("q " * 5000, "de"), ("solo" * 20000, "en")] + [("alpha beta gamma delta", "fr")] * 40


def tuples(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_is_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 3000)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 20_000)
    df = spark.createDataFrame([(i, t, lang, 1, 0.5, "p") for i, (t, lang) in enumerate(docs)], TABLE).repartition(5)
    want = brute(docs)
    assert len(want) > 80
    assert tuples(phrases.collocations(df)) == want
    assert tuples(phrases.collocations(df, best=7)) == brute(docs, best=7)


def test_same_as_sql(spark, docs):
    df = spark.createDataFrame([(i, t, lang, 1, 0.5, "p") for i, (t, lang) in enumerate(docs) if "\x00" not in (t or "")], TABLE)
    documents = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)  # noqa: F841
    assert tuples(phrases.collocations(df)) == sorted(duckdb.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.ORACLE})").fetchall())


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], TABLE)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, 0.1, ""), (2, "one two", "en", 1, 0.1, "")], TABLE)).collect() == []


def test_wide_ids_count_alike():
    """Ids too large for one key take the way by pairs, with the same nodes."""
    rng = np.random.default_rng(2)
    ids, pieces = rng.integers(1, 30, 4000), np.sort(rng.integers(0, 300, 4000))
    names = np.sort(rng.choice(1 << 30, 31, replace=False)) + 1
    small, wide = phrases.suffix_nodes(ids, pieces), phrases.suffix_nodes(names[ids], pieces)
    for a, b in zip(small, wide, strict=True):
        assert (a.counts == b.counts).all() and all((names[x] == y).all() for x, y in zip(a.ids, b.ids, strict=True))
    assert [int(x.counts.sum()) for x in small][0] == 4000


def test_products_past_64_bits(spark, monkeypatch):
    """Squares of counts beyond 64 bits keep every digit."""
    df = spark.createDataFrame([("en", "", 10**13), ("en", "a", 4 * 10**12 + 7), ("en", "b", 5 * 10**12 + 1), ("en", "a b", 3 * 10**12 + 11)], "lang string, phrase string, f long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: df)
    (row,) = phrases.collocations(df).collect()
    assert row["score"] == 10**6 * (3 * 10**12 + 11) ** 2 // ((4 * 10**12 + 7) * (5 * 10**12 + 1)) and row["n"] == 10**13
