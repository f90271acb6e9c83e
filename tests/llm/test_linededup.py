import random

import numpy as np

from memlake.llm import linededup

DOCS = "doc_id long, text string, id long, line string, n int"


def brute(rows):
    """rows: distinct (doc_id, text) in order. The lines to remove, by row."""
    seen, out = [], []
    for _, text in rows:
        gone = []
        for k, raw in enumerate((text or "").split("\n")):
            w = set(raw.replace("\t", " ").lower().split(" ")) - {""}
            if w:
                if any(5 * len(w & s) >= 4 * len(w | s) for s in seen):
                    gone.append(k)
                seen.append(w)
        out.append(gone)
    return out


def check(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in [*rows, *extra]], DOCS).repartition(5)
    got = {(r["doc_id"], r["n_lines"]): r["removed"] for r in linededup.line_dedup(df).collect()}
    want = {(i, len((t or "").split("\n"))): ",".join(map(str, gone)) for (i, t), gone in zip(rows, brute(rows), strict=True)}
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in linededup.deduped(df).collect()}
    for (i, t), gone in zip(rows, brute(rows), strict=True):
        assert kept[i] == "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)


def lines(rng, n):
    base = [[rng.choice(["of", "the", "and", "in", "to"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 20, 45]))] for _ in range(40)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        rng.shuffle(w)
        out.append(rng.choice([" ", "  "]).join(w) + rng.choice(["", "", " "]))
    return out


def test_is_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, "\n".join(lines(rng, rng.randrange(9)))) for i in range(160)]
    rows += [(500, None), (501, ""), (502, "a\tb c D e f\nA B C d e\tF"), (503, "of the and in to\n" * 50), (504, " ".join(f"y{k}" for k in range(30000)))]
    check(spark, rows)


def test_odd_ids_and_repeats(spark):
    rng = random.Random(22)
    rows = [(None, "\n".join(lines(rng, 6)))] + [(-5 + i, "\n".join(lines(rng, i % 7))) for i in range(40)] + [(1 << 60, "one two three four five six\nx")]
    check(spark, rows, [rows[3], rows[3], rows[0]])


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert linededup.line_dedup(none).count() == 0 and linededup.deduped(none).count() == 0


def test_signatures_meet_and_rare_words_need_no_links():
    """Any two sets that reach the threshold share a signature, and a set of many rare words has few of them (F1, F2: disk)."""
    rng = random.Random(23)
    ranks = {w: rng.choice([3, 5, 8, 12, 20, 30]) for w in range(4000)}

    def found(words):
        key = np.sort(np.array([ranks[w] << 56 | w for w in words], np.uint64))
        _, place, size = linededup.signatures(key, np.array([0]), np.array([len(key)]))
        return {tuple(key[p : p + s].tolist()) for p, s in zip(place, size, strict=True)}

    met = 0
    for _ in range(4000):
        a = set(rng.sample(range(4000), rng.randrange(4, 60)))
        b = set(a)
        for _ in range(rng.randrange(1, 1 + max(1, len(a) // 4))):
            b.discard(rng.choice(sorted(b)) if rng.random() < 0.5 else -1)
            b.add(rng.randrange(4000))
        if len(b) >= 4 and 5 * len(a & b) >= 4 * len(a | b):
            met += 1
            assert found(a) & found(b)
        rare = sum(ranks[w] <= linededup.RARE for w in a)
        assert 5 * rare <= len(a) or len(found(a)) <= len(a) // 5 + 1
    assert met > 500


def test_lines_of_a_large_group_meet_once(spark):
    """However many signatures two lines of a large group share, they are one row of the join; lines that differ in more words than their
    sketches of 128 bits allow are none (the check of op1 and of the pipeline: 3,537,740 rows for 253,032 pairs on check_h)."""
    line = lambda t, k, n, bits: (t, k, 45 << 32, bits, bits, n)
    near = [line(t, k, 60, 0) for t in range(9) for k in range(60)] + [line(99, 3, 4, 0), line(99, 70, 4, 0), line(99, 71, 4, -1)]
    groups = spark.createDataFrame(near + [line(t, 200 + k, 60, (1 << 6 * k) - 1) for t in range(9) for k in range(10)], "t long, id long, at long, bits long, more long, lines long")
    got = [tuple(r) for r in linededup.meeting_pairs(groups, spark.createDataFrame([(5,), (59,)], "id long")).collect()]
    want = {(b, a) for b in range(60) for a in range(b) if b not in (5, 59)} | {(70, 3)} | {(200, a) for a in range(60)} | {(200, 200)}
    # sketches of 0, 6, 12 ... bits in either half: those beside each other differ by 12, more than the 10 words that 45 and 45 may
    assert len(got) == len(set(got)) and set(got) == want - {(200, 200)}


def test_variants_that_do_not_resemble_their_first(spark):
    rng = random.Random(24)
    base = [f"w{k}" for k in range(40)]
    check(spark, [(k, " ".join(f"o{k}x{j}" if rng.random() < 0.14 else w for j, w in enumerate(base))) for k in range(120)])
