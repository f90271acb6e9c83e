"""The job machine as a stream: equal to the batch query for events dealt over files in any order, repeated, and over a restart."""

import json
import os
import random
from datetime import datetime, timezone

import pytest

from memlake.operators import jobs
from memlake.operators.capture import confirmed_proposals
from memlake.streaming import jobs as streams

BASE = 1704067200


def stamp(at):
    return datetime.fromtimestamp(at, timezone.utc).isoformat().replace("+00:00", "Z")


def dealt(folder, rows, k):
    path = folder / f"{k:03}.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (BASE + k, BASE + k))  # files are taken in the order of their times


def drained(stream, path, checkpoint):
    stream.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination(150)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(7)
    actions = ["ENQUEUED", "CLAIMED", "CLAIMED", "PROCESSING", "RENEWED", "COMMITTED", "FAILED", "TERMINAL", "REQUEUED"]
    return [{"job": rng.randrange(6), "ordinal": i, "action": rng.choice(actions), "at_s": BASE + 40 * i, "ts": stamp(BASE + 40 * i)} for i in range(160)]


def test_stream_is_the_batch(spark, tmp_path, events):
    streams.with_rocks(spark)
    (tmp_path / "in").mkdir()
    rng = random.Random(1)
    parts = [events[k : k + 40] for k in range(0, 160, 40)]
    for k, part in enumerate(parts[:2]):
        shuffled = part + rng.sample(part, 7)  # repeats within the delay
        rng.shuffle(shuffled)
        dealt(tmp_path / "in", shuffled, k)
    read = lambda: spark.readStream.schema("job long, ordinal long, action string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drained(streams.job_history_stream(read(), "40 minutes"), tmp_path / "out", tmp_path / "check")
    for k, part in enumerate(parts[2:], 2):  # after a restart, from the checkpoint; some of the first part comes again, too late
        dealt(tmp_path / "in", rng.sample(part, len(part)) + events[:5], k)
    dealt(tmp_path / "in", [{"job": 99, "ordinal": 1000, "action": "ENQUEUED", "ts": stamp(BASE + 10**6)}], 9)
    drained(streams.job_history_stream(read(), "40 minutes"), tmp_path / "out", tmp_path / "check")
    got = sorted(tuple(r) for r in spark.read.schema(jobs.HISTORY).parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame([(e["job"], e["ordinal"], e["action"], e["at_s"]) for e in events], "job long, ordinal long, action string, at_s long")
    assert got == sorted(tuple(r) for r in jobs.job_history(batch.unionByName(batch.limit(20))).collect())
    assert {r[6] for r in got} >= {"QUEUED", "CLAIMED", "COMMITTED", "DEAD_LETTER"} and any(r[5] for r in got)


def test_what_is_committed_stays(spark):
    rows = [(1, 1, "ENQUEUED", 0), (1, 2, "CLAIMED", 10), (1, 3, "COMMITTED", 20), (1, 4, "CLAIMED", 30), (1, 5, "ENQUEUED", 40), (2, 6, "ENQUEUED", 0), (2, 7, "CLAIMED", 5), (2, 8, "RENEWED", 200), (2, 9, "COMMITTED", 499), (3, 10, "ENQUEUED", 0), (3, 11, "CLAIMED", 1), (3, 12, "COMMITTED", 301)]
    df = spark.createDataFrame(rows, "job long, ordinal long, action string, at_s long")
    got = {r["ordinal"]: (r["accepted"], r["status"], r["expired"]) for r in jobs.job_history(df).collect()}
    assert got[3] == (True, "COMMITTED", False) and got[4] == (False, "COMMITTED", False) and got[5] == (False, "COMMITTED", False)
    assert got[9] == (True, "COMMITTED", False) and got[12] == (False, "QUEUED", True)
    assert {r["job"]: r["status"] for r in jobs.job_states(df, 250).collect()} == {1: "COMMITTED", 2: "CLAIMED", 3: "CLAIMED"}
    assert {r["job"]: (r["status"], r["recovered"]) for r in jobs.job_states(df.where("ordinal != 9"), 500).collect()}[2] == ("QUEUED", True)


def test_approvals_over_increments(spark, tmp_path):
    streams.with_rocks(spark)
    (tmp_path / "in").mkdir()
    turns = [(s, i, "assistant" if i % 2 == 0 else "user", ["we could use redis", "tamam", "and now?", "no, not that", "use pytest", "ok"][i], BASE + 60 * i) for s in (1, 2) for i in range(6)]
    rows = [{"session": s, "ordinal": i, "role": r, "content": c, "ts": stamp(at)} for s, i, r, c, at in turns]
    for k in range(6):
        dealt(tmp_path / "in", [x for x in rows if x["ordinal"] == 5 - k or (x["session"] == 2 and x["ordinal"] == k)], k)
    dealt(tmp_path / "in", [{"session": 9, "ordinal": 0, "role": "user", "content": "later", "ts": stamp(BASE + 10**5)}], 9)
    read = spark.readStream.schema("session long, ordinal long, role string, content string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drained(streams.approvals_stream(read, "20 minutes"), tmp_path / "out", tmp_path / "check")
    got = sorted(tuple(r) for r in spark.read.schema(streams.APPROVED).parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame([t[:4] for t in turns], "session long, ordinal long, role string, content string")
    assert got == sorted(tuple(r) for r in confirmed_proposals(batch).select("session", "ordinal", "reply").collect()) and len(got) == 4
