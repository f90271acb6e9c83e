"""Batches of evidence: the same batch twice changes nothing, other metadata for an id is reported and not stored."""

from memlake.streaming import evidence

TURN = "session long, ordinal long, role string, content string"


def rows(spark, path, name, schema):
    return sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{path}/{name}").collect())


def test_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    run = evidence.upsert_into(path)
    first = evidence.evidence_rows(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None)], TURN), 10)
    run(first, 0)
    stored = rows(spark, path, "rows", evidence.STORED)
    assert len(stored) == 2 and rows(spark, path, "conflicts", evidence.CONFLICT) == []
    run(first, 0)  # the same batch again
    run(evidence.evidence_rows(spark.createDataFrame([(1, 0, "user", "hi")], TURN), 99), 1)  # the same evidence later
    assert rows(spark, path, "rows", evidence.STORED) == stored
    changed = evidence.evidence_rows(spark.createDataFrame([(1, 0, "user", "ho"), (2, 0, "user", "new"), (2, 0, "tool", "new")], TURN), 20)
    for _ in range(2):
        run(changed, 2)
        assert len(rows(spark, path, "rows", evidence.STORED)) == 3
        assert len(rows(spark, path, "conflicts", evidence.CONFLICT)) == 2


def test_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"session": 1, "ordinal": 0, "role": "user", "content": "x"}\n' * 3)
    read = lambda: spark.readStream.schema(TURN).json(str(tmp_path / "in"))
    for _ in range(2):
        evidence.evidence_rows(read(), 5).writeStream.foreachBatch(evidence.upsert_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(90)
    assert len(rows(spark, tmp_path / "out", "rows", evidence.STORED)) == 1
