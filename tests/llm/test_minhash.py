import random

import pytest

from memlake.llm import components, minhash

DOCS = "doc_id long, text string, page string, component long, key string"


def brute(texts, width=5):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    return sets, links


def classes(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in out:
                    out[j] = i
                    stack.extend(links[j])
    return out


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(12)]
    out = {i: " ".join(base[i % 12]) for i in range(30)}
    out |= {100 + i: noisy(rng, base[i % 3], rng.choice([1, 1, 2, 3, 9])) for i in range(330)}
    out |= {600: None, 601: "", 602: " \n\t", 603: "two words", 604: "two words", 605: "TWO\nwords", 606: " ".join(f"x{k}" for k in range(30000)), 607: "e"}
    return out


def test_join_is_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "p", 7, "k") for i, t in texts.items()] + [(3, texts[3], None, None, None)], DOCS).repartition(5)
    got = {r["doc_id"]: r for r in minhash.jaccard_join(df, 0.99999).collect()}
    assert len(got) == len(texts)
    _, links = brute(texts)
    named = classes(links)
    assert {i: len(x) for i, x in links.items()} == {i: r["n_links"] for i, r in got.items()}
    assert named == {i: r["class_id"] for i, r in got.items()}


def test_join_of_nothing(spark):
    assert minhash.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    alone = minhash.jaccard_join(spark.createDataFrame([(None, "a b c d e f", None, None, None), (1, "g h", None, None, None)], DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in alone) == [(-1, 0), (1, 0)]


def test_copies_without_an_id(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "y"]), " ".join(reversed(words)), " ".join([*reversed(words), "x"])]
    rows = [(None, texts[0]), *((i, texts[0]) for i in range(1, 6)), (6, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (8, "other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 99, r["class_id"] or 99, r["n_copies"], r["n_links"]) for r in minhash.jaccard_join(docs).collect()))
    assert got == [*((i, 1, 6, 7) for i in range(1, 6)), (6, 1, 1, 7), (8, 8, 1, 0), (99, 1, 1, 7), (99, 1, 6, 7), (99, 99, 1, 0), (99, 99, 1, 1), (99, 99, 1, 1)]
    full = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, full, "").collect()]
    assert len(kept) == 4 and {(1, texts[0]), (8, "other words"), (None, None)} < set(kept) and ({(None, texts[3]), (None, texts[4])} & set(kept))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == classes(links)


def test_recall_of_the_banding():
    assert minhash.recall(0.8, minhash.bands_for(0.9995), 5) >= 0.9995
    assert minhash.recall(0.3, minhash.bands_for(0.9995), 5) < 0.06
