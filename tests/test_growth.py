"""What operators shuffle and evaluate grows with their input: few rows a row, each text judged once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import audit, reports, subjects, upkeep

from test_similarity import shuffled


def test_words_of_deliveries_are_no_rows(spark):
    said = spark.createDataFrame([(s, "assistant", " ".join(f"word{w}" for w in range(s, s + 40))) for s in range(40)], "session long, role string, content string")
    records = spark.createDataFrame([(f"m{k}", " ".join(f"word{w}" for w in range(k, k + 40))) for k in range(40)], "memory_id string, content string")
    delivered = spark.createDataFrame([(s, f"m{k}") for s in range(40) for k in range(40)], "session long, memory_id string")
    got, n = shuffled(spark, lambda: reports.used_records(delivered, records, said).collect())
    assert {tuple(r) for r in got} == {(s, f"m{k}") for s in range(40) for k in range(40) if abs(s - k) <= 20}
    assert n < 8000  # 1600 deliveries have 64000 words


def test_a_large_block_has_few_tiles(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "a", [float(c) for c in rng.normal(size=4)]) for i in range(600)], "id long, block string, embedding array<double>")
    _, n = shuffled(spark, lambda: audit.cosine_pairs(df, 0.999, 3).count())
    assert n < 30 * 600  # 200 tiles of three would be 120000 rows


def test_entities_of_questions_are_not_shuffled(spark, monkeypatch):
    """every question hits every entity. The rows grow with the product, what is shuffled does not, and a join by shuffles agrees."""
    asked = spark.createDataFrame([(q, f"Redis {'cache' if q % 2 else 'store'} {q}") for q in range(200)] + [(500, None), (501, "")], "question long, text string")
    entities = spark.createDataFrame([(f"e{k:03}", "redis" if k % 5 == 0 else f"a redis cache {k}", ["MEMORY", "TECHNOLOGY", None][k % 3]) for k in range(150)] + [(None, "Redis", "PHASE"), ("e000", "redis store", "PHASE")], "id string, name string, type string")
    order = ["question", "rank"]
    got, n = shuffled(spark, lambda: subjects.subject_entities(asked, entities).orderBy(*order).count())
    assert got == 200 * 151 and n < 15_000
    rows = subjects.subject_entities(asked, entities).orderBy(*order).collect()
    monkeypatch.setattr(subjects, "HITS", 0)
    monkeypatch.setattr(subjects, "ROWS", 0)
    monkeypatch.setattr(subjects, "TOGETHER", 5000)
    assert rows == subjects.subject_entities(asked, entities).orderBy(*order).collect()
    assert [r["rank"] for r in rows] == list(range(1, 152)) * 200
    assert all(r["typed"] is None for r in rows if r["id"] == "e002")
    assert [(r["id"], r["exact"], r["typed"]) for r in rows[:2]] == [("e000", True, True), (None, True, True)]


@pytest.mark.parametrize("label", ["QUOTED", "OBSERVED"])
def test_a_rule_reads_its_label_once(spark, label):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(_):
        read.add(1)
        return label

    df = spark.createDataFrame([("LIFECYCLE_TARGET_UNKNOWN", "lesson", f"a longer sentence than that {k}") for k in range(50)], "reason string, kind string, content string")
    rule = upkeep.noise_rule(F.col("reason"), F.col("c"), F.col("kind"), F.col("content"))
    plan = df.withColumn("c", F.upper("content")).select(rule.alias("rule"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    got = {r["rule"] for r in df.withColumn("c", once("content")).select(rule.alias("rule")).collect()}
    assert got == {{"QUOTED": "QUOTED", "OBSERVED": "OBSERVED_UNKNOWN_TARGET"}[label]}


def test_a_scan_of_vectors_leaves_its_best_only():
    """However many batches a task reads, it leaves k rows a query, and holds the products of `SLICE` vectors."""
    import tracemalloc

    import pandas as pd

    from memlake.operators import search

    rng = np.random.default_rng(2)
    matrix, every = rng.normal(size=(1024, 8)), rng.normal(size=(20000, 8)).round(1)
    frames = [pd.DataFrame({"vec_id": np.arange(lo, lo + 10000), "embedding": list(every[lo : lo + 10000])}) for lo in (0, 10000)]
    tracemalloc.start()
    out = pd.concat(search._nearest(np.arange(1024), matrix, 3)(iter(frames)))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(out) == 3 * 1024 and most < 100
    near = np.round(matrix[:5] @ every.T / (np.linalg.norm(matrix[:5], axis=1)[:, None] * np.linalg.norm(every, axis=1)), 9)
    want = [sorted(range(20000), key=lambda j: (-near[q, j], j))[:3] for q in range(5)]
    assert [out["vec_id"][out["query_id"] == q].tolist() for q in range(5)] == want
