import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length long, piece string, rank int"


def test_pieces_and_places(spark):
    rng = random.Random(1)
    words = ["The", "river's", "ÉTÉ", "日本", "don't", "12,5", "x\ty", "<|endoftext|>", "a" * 60, "Straße!!", "İx", "’s"]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300, 900, 3000])))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "no id"), (5, rows[5][1]), (5, rows[5][1])]
    got = packing.best_fit_pack(spark.createDataFrame([(*r, 1, "p", 2) for r in rows], DOCS).repartition(3), PATH).collect()
    tok, want = Tokenizer.from_file(PATH), []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((-1 if i is None else i, k, at, len(own), zlib.crc32(array("I", own).tobytes())))
    assert sorted(want) == sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(w[3] for w in want) // 2048) * 1.05 + 1


def test_nothing(spark):
    assert packing.best_fit_pack(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(3000):
        n = rng.choice([1, 2, 3, rng.randrange(1, 101), rng.randrange(1, 101), 100])
        counts[n] = counts.get(n, 0) + rng.randrange(1, 4)
    plan = packing.plan_bins(counts, 100)
    out = {}
    for pattern, times in plan:
        assert sum(a * b for a, b in pattern) <= 100
        for length, n in pattern:
            out[length] = out.get(length, 0) + n * times
    assert out == counts
    assert sum(t for _, t in plan) <= -(-sum(k * v for k, v in counts.items()) // 100) * 1.01 + 1


def test_two_tighter():
    import numpy as np

    left = np.zeros(51, np.int64)
    left[[10, 20, 21, 30]] = [1, 1, 2, 1]
    assert packing.two_tighter(left, 50, 40) == (30, 20)
    assert packing.two_tighter(left, 42, 30) == (21, 21)
    assert packing.two_tighter(left, 19, 5) is None
