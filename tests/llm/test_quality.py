import random
import zlib

import numpy as np
import pytest

from memlake.llm import quality

DOCS = "doc_id long, text string, score double, y int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["over", "the", "river", "old", "stone", "bridge", "was", "built"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(8, 60)))
    loud = lambda: " ".join(rng.choice(["BUY", "NOW", "CLICK", "FREE"]) + "!!" for _ in range(rng.randrange(8, 60)))
    return [(i, plain() if i % 4 else loud(), 1.0, 2) for i in range(600)]


def test_held_out_accuracy(spark, rows):
    extra = [(1000, None, 1.0, 2), (1001, "", 1.0, 2), (None, "the old bridge", 1.0, 2), (5, rows[5][1], 1.0, 2), (1002, "stone " * 40000, 1.0, 2)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(out) > 60 and np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in out]) > 0.97
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1


def test_without_labels_and_without_rows(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_scores(spark.createDataFrame(rows[:9], DOCS), none).collect()} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], DOCS), none).count() == 0


def test_shapes():
    assert [quality.shape_of(t) for t in ("NOW!!", "the###", "|", "a1-B")] == ["X!", "x#", "|", "x9-X"]
