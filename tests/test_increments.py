"""The byte-offset source: growth, unfinished lines, rewrites and shrinking, over restarts from one checkpoint."""

import json

import pytest

from memlake.sources.increments import growing_lines, transcript_rows

LINE = {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "tool_result", "text": "no"}, {"type": "text", "text": "two"}]}}


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def once(**options):
        stream = transcript_rows(growing_lines(spark, str(tmp_path / "in"), **options))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = spark.read.schema("file string, byte_start long, byte_end long, role string, content string").parquet(str(tmp_path / "out")).collect()
        return sorted((r["byte_start"], r["byte_end"], r["role"], r["content"]) for r in rows)

    return once, tmp_path / "in" / "a.jsonl"


def test_growth_and_unfinished_lines(run):
    once, path = run
    first, second, third = json.dumps(LINE), json.dumps({"role": "assistant", "content": "naïve\r "}, ensure_ascii=False), json.dumps({"type": "progress"})
    path.write_text(first + "\n" + second[:9], encoding="utf-8")
    n = len(first) + 1
    assert once() == [(0, n, "user", "one\ntwo")]
    assert once() == [(0, n, "user", "one\ntwo")]  # the unfinished line waits
    path.write_text(first + "\n" + second + "\n" + third + "\n", encoding="utf-8")
    m = n + len(second.encode()) + 1
    assert once() == [(0, n, "user", "one\ntwo"), (n, m, "assistant", "naïve\r "), (m, m + len(third) + 1, "other", None)]


def test_over_long_lines_are_seen(run):
    once, path = run
    path.write_text("x" * 5000 + "\n" + json.dumps({"role": "user", "content": "b"}) + "\n")
    got = once(lineBytes="1000", batchBytes="100")
    assert [(r[0], r[2], r[3]) for r in got] == [(0, "oversized", None), (5001, "user", "b")]


@pytest.mark.parametrize("change", ["rewrite", "shrink"])
def test_a_changed_past_fails(run, change):
    once, path = run
    rows = [json.dumps({"role": "user", "content": f"say {i}"}) + "\n" for i in range(4)]
    path.write_text("".join(rows))
    assert len(once()) == 4
    path.write_text("".join(rows).replace("say 0", "say 9") + rows[0] if change == "rewrite" else rows[0])
    with pytest.raises(Exception, match="TRANSCRIPT_REWRITTEN"):
        once()
