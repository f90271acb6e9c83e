import random

import pytest
from test_minhash import brute, classes, noisy

from memlake.llm import linededup, passages
from memlake.llm.common import BitTable, mixed

DOCS = "doc_id long, text string, number long, id long, passage string"


def word_order(words):
    h = linededup.line_words([0], [" ".join(words)])[1]
    return [int(x) for x in mixed(h ^ passages.np.uint64(0x5851F42D4C957F2D))]


def cut_up(text):
    """Plainly: the paragraphs of a text, as (place of the first word, words)."""
    words = (text or "").lower().split()
    if not words:
        return []
    h, r = word_order(words), passages.REACH
    begins = [k for k in range(len(words)) if k == 0 or (all(h[k] < x for x in h[max(0, k - r) : k]) and all(h[k] <= x for x in h[k + 1 : k + 1 + r]))]
    return [(a, words[a:b]) for a, b in zip(begins, [*begins[1:], len(words)], strict=True)]


def expected(rows, least=passages.LEAST_PASSAGE):
    units = {(k, at): words for k, text in enumerate(rows) for at, words in cut_up(text)}
    named = classes(brute({u: " ".join(w) for u, w in units.items()})[1])
    gone = {u for u, first in named.items() if u != first}
    out = {}
    for k in range(len(rows)):
        run = []
        for at in [*sorted(a for d, a in gone if d == k), None]:
            if run and (at is None or at != run[-1] + len(units[k, run[-1]])):
                if sum(len(units[k, a]) for a in run) >= least:
                    out |= {(k, a): named[k, a] for a in run}
                run = []
            run += [] if at is None else [at]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda p: f"{p}{rng.randrange(10**6)}"
    long, short, plain = [word("p") for _ in range(60)], [word("s") for _ in range(14)], [word("c") for _ in range(200)]
    out = []
    for i in range(40):
        own = [word("r") for _ in range(60)]
        at = rng.randrange(60)
        if i % 4 == 0:
            own[at:at] = long if i % 8 else noisy(rng, long, 1).split()
        if i % 5 == 1:
            own[at:at] = short
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in own))
    return [*out, None, "", " \n\t", out[3], out[3].upper(), *(" ".join([*plain, f"end{k}"]) for k in range(6)), "a b " * 300, "a b " * 300]


@pytest.mark.parametrize("small", [2, passages.SMALL])
def test_passages_are_brute_force(spark, rows, small, monkeypatch):
    monkeypatch.setattr(passages, "SMALL", small)
    df = spark.createDataFrame([(i, t, 5, 6, "p") for i, t in enumerate(rows)] + [(3, rows[3], 1, None, None)], DOCS).repartition(3)
    got = {(r["doc_id"], r["start_word"]): (r["kept_doc_id"], r["kept_start_word"]) for r in passages.repeated_passages(df, target_recall=0.999999).collect()}
    want = expected(rows)
    assert got == want
    assert {k for k, _ in want} >= {4 * i for i in range(1, 10)} - {8 * i for i in range(6)} and 1 not in {k for k, _ in want}


def test_without_ids_and_nothing(spark, rows):
    df = spark.createDataFrame([(None, rows[4]), (7, rows[12]), (7, rows[20]), (8, "other words"), (None, None)], "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    assert {r["doc_id"] for r in found} == {7} and {r["kept_doc_id"] for r in found} == {None}
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_a_long_text_comes_in_parts(monkeypatch):
    text = " ".join(f"w{k}" for k in range(500))
    monkeypatch.setattr(passages, "TOGETHER", 300)
    found, at = passages.Paragraphs(), []
    for own, parts in passages.parts_of([9, 4], [text, "x y"]):
        found(own, parts)
        at += zip(found.number.tolist(), found.at.tolist(), found.n.tolist(), strict=True)
    assert sum(n for k, _, n in at if k == 9) == 500 and all(a + n == b for (i, a, n), (j, b, _) in zip(at, at[1:], strict=False) if i == j) and at[-1] == (4, 0, 2)


def test_recall_of_passages(spark):
    """With production parameters, of passages of 50 words in otherwise different texts, at any place, nine of ten are found at least."""
    rng = random.Random(11)
    rows = []
    for i in range(200):
        passage = [f"p{i}x{k}" for k in range(50)]
        for _ in range(2):
            own = [f"r{rng.randrange(10**9)}" for _ in range(80)]
            own[(at := rng.randrange(80)) : at] = passage
            rows.append((len(rows), " ".join(own)))
    found = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 180 and all(k % 2 for k in found)


def test_asked_paragraphs_are_found_where_the_texts_are(spark, rows):
    """op8's disk: however many paragraphs are asked for, no text is joined or shuffled, and none of them is missed."""
    df = spark.createDataFrame([(k, text or "") for k, text in enumerate(rows)], "number long, text string")
    asked = [k << 20 | at for k, text in enumerate(rows) for at, _ in cut_up(text)][::3]
    found = passages.shingle_sets(df, spark.createDataFrame([(i,) for i in asked], "id long"), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = [r["id"] for r in found.collect()]
    assert len(got) == len(set(got)) and set(asked) <= set(got) and len(got) < 1.2 * len(asked)


def test_bit_table_misses_none(spark):
    rng = random.Random(8)
    ids = [rng.randrange(1 << 55) for _ in range(3000)] + [0, (1 << 62) + 5]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    other = passages.np.array([rng.randrange(1 << 55) for _ in range(3000)])
    for most in (1 << 16, 1 << 29):
        table = BitTable(df, most=most)
        assert table.has(passages.np.array(ids)).all() and table.has(other).mean() < (0.1 if most == 1 << 16 else 0.04)
    assert not BitTable(df.where("id < 0")).has(other).any()
