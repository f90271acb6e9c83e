import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from memlake.llm import lm

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score double, n long"


def tokens(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [*out, None]


def test_scores_are_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "The", "Straße", "ÉTÉ", f"w{rng.randrange(40)}", "a\tb", "日本"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "İ \x1c \xa0x"), (203, "y" * 5000), (7, rows[7][1]), (None, "no id")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], DOCS).repartition(4)
    got = lm.score_texts(df, MODEL, 7, 2, frequent_words=10).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows)
    assert want == sorted((-1 if r[0] is None else r[0], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 for r in got)
    same = {r["score"] for r in lm.score_texts(df, MODEL, 7, 2).where("doc_id = 9").collect()} | {r["score"] for r in got if r["doc_id"] == 9}
    assert max(same) == pytest.approx(min(same))


def test_lattice_sums_all_segmentations():
    weights = {f"<0x{b:02X}>": -6.0 for b in range(256)} | {"▁": -1.0, "▁a": -0.7, "a": -1.2, "ab": -0.9, "b": -1.1, "▁ab": -2.0}
    pieces = lm.Pieces(weights, -1.0)

    def every(s):
        if not s:
            return 1.0
        total = 10 ** (-6.0 * len(s[0].encode())) * every(s[1:])
        return total + sum(10 ** weights[s[:k]] * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in weights)

    for word in ("a", "ab", "abab", "aéb", "bba"):
        assert pieces.word(word) == pytest.approx(math.log10(every("▁" + word)))


def test_nothing(spark):
    assert lm.lattice_scores(spark.createDataFrame([], DOCS), MODEL).count() == 0


def test_a_document_is_the_sum_over_all_spellings(spark):
    """Against plain enumeration: every way to cut a word, its mark included, into pieces of the vocabulary or single characters as bytes."""
    words = spark.createDataFrame([(bytearray(w), n, n) for w, n in ((b"the", 9), (b"house", 2), (b"h\xc3\xa9", 1), (lm.END, 3))], "word binary, n long, n_all long")
    pieces = lm.trained_pieces(words, MODEL)

    def spellings(s):
        if not s:
            return 1.0
        total = 10 ** sum(pieces.bytes[b] for b in s[0].encode()) * spellings(s[1:])
        return total + sum(10 ** pieces.weights[s[:k]] * spellings(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces.weights)

    for word in ("the", "house", "hé", "zq", "日本"):
        assert pieces.word(word) == pytest.approx(math.log10(spellings("▁" + word)), abs=1e-9)
    rows = [(1, "the house the"), (3, "hé zq"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    model = lm.trained_pieces(spark.createDataFrame([(bytearray((w or "\n").encode()), n, n) for w, n in counts.items()], "word binary, n long, n_all long"), MODEL)
    for frequent in (0, 100):
        got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, MODEL, 7, 2, frequent_words=frequent).collect()}
        assert got == pytest.approx({i: sum(model.end if t is None else model.word(t) for t in tokens(text)) for i, text in rows}, abs=1e-9)
