"""Operations once: the same batch again gives what is stored, a changed one fails closed."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import truth
from memlake.plans import truth as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    return plans._batch(spark, SF).where("operation_id in ('op_0', 'op_1', 'op_2', 'op_3', 'op_4', 'op_5', 'op_6')")


@pytest.fixture(scope="module")
def parts(spark):
    return plans._store(spark, SF), plans.views.projects(spark, SF)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_twice_changes_nothing(spark, batch, parts, tmp_path):
    safe = batch.withColumn("content", F.lit("a plain note ")).withColumn("scope", F.lit("global")).withColumn("project_id", F.lit("")).withColumn("approved", F.lit(True)).withColumn("commitment", F.lit("COMMITTED")).withColumn("operation", F.lit("NEW")).withColumn("successor_id", F.concat(F.lit("new_"), "candidate_id"))
    safe = safe.withColumn("content", F.concat("content", "candidate_id")).withColumn("claim_key", F.lit("")).withColumn("fingerprint", F.when(F.col("position") == 6, F.lit("same")).otherwise(F.sha2("content", 256)))
    safe.write.parquet(str(tmp_path / "batch"))
    safe = spark.read.parquet(str(tmp_path / "batch"))
    first = truth.process(safe, *parts, *plans._nothing(spark)).written(str(tmp_path / "first"))
    decisions = rows(first.decisions)
    assert len(decisions) == 49 and {d[3] for d in decisions} == {"NEW", "DUPLICATE"}
    assert first.receipts.count() == 7 and first.records.count() == parts[0].count() + 43
    again = truth.process(safe, first.records, parts[1], first.receipts, first.receipted).written(str(tmp_path / "again"))
    assert {r["state"] for r in again.operations.collect()} == {"REPLAY"}
    assert rows(again.decisions) == decisions
    assert rows(again.records) == rows(first.records) and again.receipts.count() == 7
    changed = safe.withColumn("source", F.when(F.col("position") == 3, "review").otherwise(F.col("source")))
    assert {r["state"] for r in truth.operation_states(changed, first.receipts).collect()} == {"MISMATCH"}
    with pytest.raises(Exception, match="operation identity mismatch"):
        truth.operation_states(changed, first.receipts, strict=True).collect()
    swapped = safe.withColumn("position", 6 - F.col("position"))
    assert {r["state"] for r in truth.operation_states(swapped, first.receipts).collect()} == {"MISMATCH"}


def test_receipts_from_before_provenance(spark, batch):
    old = truth.operation_hashes(batch).withColumn("provenance_hash", F.lit(None).cast("string"))
    states = {r["operation_id"]: r["state"] for r in truth.operation_states(batch, old).collect()}
    assert states["op_0"] == "REPLAY" and states["op_1"] == "MISMATCH"


def test_unsettled_operations_are_decided_again(spark, batch, parts, tmp_path):
    done = truth.process(batch, *parts, *plans._nothing(spark)).written(str(tmp_path / "done"))
    open_ = {r["operation_id"] for r in done.decisions.collect() if r["action"] in truth.UNSETTLED}
    assert open_ and not open_ & {r["operation_id"] for r in done.receipts.collect()}
    assert truth.process(batch.where("false"), *parts, *plans._nothing(spark)).decisions.collect() == []


def test_prior_fields_are_carried(spark):
    stored = spark.createDataFrame([("mem_1", "resolved", "mem_9", 5, True), ("mem_2", "active", "", 6, False)], "memory_id string, status string, superseded_by string, at_s long, is_approved boolean")
    keys = spark.createDataFrame([("k1", "mem_2"), ("k1", "mem_1"), ("k2", "mem_2")], "key string, memory_id string")
    new = spark.createDataFrame([("a", ["k0", "k1"], 9, False, "x", 0.5), ("b", ["k0"], 9, False, "y", 0.5), ("c", ["k2", "k1"], 9, False, "z", 0.5)], "candidate_id string, aliases array<string>, at_s long, is_approved boolean, content string, confidence double")
    got = {r["candidate_id"]: r for r in truth.merged_with_prior(new, stored, keys).collect()}
    assert (got["a"]["memory_id"], got["a"]["status"], got["a"]["superseded_by"], got["a"]["at_s"], got["a"]["is_approved"]) == ("mem_1", "resolved", "mem_9", 5, True)
    assert (got["b"]["memory_id"], got["b"]["merge"], got["b"]["at_s"]) == ("", "new", 9) and got["c"]["memory_id"] == "mem_2"


def test_contents_are_read_once(spark, batch, parts):
    """What a batch gives is planned over narrow tables: no content is hashed or judged again."""
    done = truth.process(batch, *parts, *plans._nothing(spark))
    for name in ("operations", "decisions", "records", "receipts", "receipted"):
        plan = getattr(done, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in plan and "parquet" not in plan, name
