"""Readers, snapshot commits and the streaming forms, on small literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.functions.text import capture_reason
from memlake.operators.records import supersession_chains
from memlake.sources.readers import daily_notes, hook_events, store_document, transcript
from memlake.sources.store import RevisionConflict, SnapshotStore
from memlake.streaming.capture import enqueued_once, ledger_stream, lease_verdicts


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_readers(spark, tmp_path):
    store = tmp_path / "store.json"
    store.write_text(json.dumps({"schema_version": 2, "revision": 4, "validated_memory": [{"memory_id": "a", "content": "x"}, {"memory_id": "b", "status": "resolved"}]}))
    assert [tuple(r) for r in store_document(spark, str(store)).select("revision", "store_ordinal", "memory_id", "status").orderBy("store_ordinal").collect()] == [(4, 0, "a", "active"), (4, 1, "b", "resolved")]
    said = lines(tmp_path / "t.jsonl", [{"role": "human", "content": "hi"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}]}}, {"type": "progress"}, {"role": "user", "content": "s", "isCompactSummary": True}])
    assert [tuple(r) for r in transcript(spark, said).orderBy("ordinal").select("role", "content").collect()] == [("user", "hi"), ("assistant", "yes"), ("summary", "s")]
    notes = tmp_path / "daily.md"
    notes.write_text("intro\n# Daily Notes - 2024-01-02\none\ntwo\n# Daily Notes - 2024-01-03\nthree\n")
    assert [(r["day"], r["content"]) for r in daily_notes(spark, str(notes)).orderBy("day").collect()] == [("2024-01-02", "one\ntwo"), ("2024-01-03", "three")]


def test_hook_events(spark):
    good = {"event_type": "USER_PROMPT", "session_id": "s", "event_at": "2024-01-01T00:00:00Z", "prompt": "hello"}
    rows = [json.dumps(good), json.dumps({**good, "extra": 1}), "nothing", json.dumps({**good, "event_type": "OTHER"}), json.dumps({**good, "event_at": "soon"})]
    accepted, refused = hook_events(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert [(r["session_id"], r["prompt_chars"]) for r in accepted.collect()] == [("s", 5)]
    assert sorted(r["reason"] for r in refused.collect()) == ["EVENT_AT", "EVENT_TYPE", "NOT_AN_OBJECT", "UNKNOWN_FIELD"]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert store.revision() == 0
    assert store.commit(rows, 0) == 1
    with pytest.raises(RevisionConflict):
        store.commit(rows, 0)
    assert store.append_new(spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "id string, n int"), "id", 1) == 2
    assert sorted(map(tuple, store.load().collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert store.load(1).count() == 2
    assert store.manifest().first()["rows"] == 3


def test_capture_reasons(spark):
    cases = [("a note", ""), ("x" * 6000, ""), ("x" * 6001, "payload_too_large"), ("\n" * 80, ""), ("l\n" * 81, "too_many_lines"), ("password = hunter2hunter2", "potential_secret"), ("Authorization: Bearer abcdefghijklmnop", "potential_secret"), ("user: " + "y" * 100 + "\nassistant: " + "y" * 100 + "\nuser: " + "y" * 100 + "\nassistant: " + "y" * 60, "transcript_like"), ("user: a\nuser: b\nuser: c", "")]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string")
    assert [r["r"] for r in df.select("k", capture_reason(F.col("c")).alias("r")).orderBy("k").collect()] == [w for _, w in cases]


def test_chains(spark):
    rows = [("a", "b"), ("b", "c"), ("c", ""), ("x", "gone"), ("p", "q"), ("q", "p")]
    got = {r["memory_id"]: (r["hops"], r["last"], r["unfinished"]) for r in supersession_chains(spark.createDataFrame(rows, "memory_id string, superseded_by string")).collect()}
    assert got["a"] == (2, "c", False) and got["b"] == (1, "c", False) and got["x"] == (0, "x", False) and got["p"][2] and "c" not in got


EVENTS = [
    {"ordinal": 1, "session": 1, "job": 1, "action": "ENQUEUED", "attempt": 1, "ts": "2024-01-01T00:00:00Z"},
    {"ordinal": 2, "session": 1, "job": 1, "action": "ENQUEUED", "attempt": 1, "ts": "2024-01-01T00:00:05Z"},
    {"ordinal": 3, "session": 1, "job": 1, "action": "COMMITTED", "attempt": 1, "ts": "2024-01-01T00:01:00Z"},
    {"ordinal": 4, "session": 2, "job": 2, "action": "CLAIMED", "attempt": 3, "ts": "2024-01-01T00:00:00Z"},
    {"ordinal": 5, "session": 2, "job": 3, "action": "CLAIMED", "attempt": 1, "ts": "2024-01-01T00:00:00Z"},
]
LATER = [{"ordinal": 6, "session": 9, "job": 9, "action": "ENQUEUED", "attempt": 1, "ts": "2024-01-01T02:00:00Z"}]


def drained(stream, name, mode, folder):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in/1.json", EVENTS)
    lines(tmp_path / "in/2.json", LATER)
    events = lambda: ledger_stream(spark, str(tmp_path / "in"), 1)
    once = drained(enqueued_once(events(), ["session", "job", "action"]), "once", "append", tmp_path / "c1")
    assert sorted(r["ordinal"] for r in once.collect()) in ([1, 3, 4, 5, 6], [2, 3, 4, 5, 6])
    verdicts = {(r["job"], r["verdict"]) for r in drained(lease_verdicts(events()), "verdicts", "append", tmp_path / "c2").collect()}
    assert (1, "COMMITTED") in verdicts and (2, "DEAD_LETTER") in verdicts and (3, "REQUEUE") in verdicts
