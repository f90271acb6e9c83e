"""Greedy selections against plain versions of them, and operators on rows that the tables lack."""

from pyspark.sql import functions as F

from memlake.operators import reports, selection, tasks


def test_digest_looks_behind_any_number_of_near_copies(spark):
    rows = [("lesson", f"a{k:03}", 0.9, 0.9, f"always run every single test before release number{k}") for k in range(95)]
    rows += [("lesson", f"b{k:03}", 0.8, 0.8, f"topic{k // 10} word{k // 10} thing{k // 10} note{k // 10} extra{k}") for k in range(60)]
    rows += [("decision", "c0", 0.5, 0.5, "only one"), ("decision", "c1", 0.4, 0.5, ""), ("decision", "c2", 0.4, 0.5, "")]
    df = spark.createDataFrame(rows, "type string, memory_id string, quality_score double, confidence double, content string")
    got = {}
    for r in selection.digest(df, k=5, group=10).orderBy("type", "rank").collect():
        got.setdefault(r["type"], []).append(r["memory_id"])
    want = {}
    for kind in ("lesson", "decision"):
        kept = []
        for _, name, _, _, content in sorted((r for r in rows if r[0] == kind), key=lambda r: (-r[2], -r[3], r[1])):
            own = set(content.split())
            if all(not own or not s or len(own & s) / len(own | s) < 0.6 for _, s in kept):
                kept.append((name, own))
        want[kind] = [n for n, _ in kept[:5]]
    assert got == want


def test_candidates_of_an_approved_decision_and_of_pasted_output(spark):
    turns = [
        (1, 0, "assistant", "We will use Redis for the cache. Should we add Docker?", "p", 1), (1, 1, "user", "tamam", "p", 2),
        (1, 2, "user", "Hmm, we decided to keep ee pytest; no, we decided to drop it", "p", None), (1, 3, "user", "see tool exec result", "p", 3),
        (1, 4, "user", None, "p", 4), (2, 0, "user", "we decided to go", None, 5), (2, 1, None, "we decided to stay", "p", 5),
    ]
    df = spark.createDataFrame(turns, "session long, ordinal long, role string, content string, project_id string, at_s long")
    got = {(r["session"], r["ordinal"], r["segment"], r["kind"], r["reason"], r["approver"], r["content"]) for r in tasks.candidates(df).collect()}
    assert got == {
        (1, 0, 0, "NEW_MEMORY", "", 1, "We will use Redis for the cache."), (1, 0, 1, "QUARANTINE", "QUESTION_NOT_COMMITMENT", None, "Should we add Docker?"),
        (1, 2, 0, "NEW_MEMORY", "", None, "we decided to keep pytest"), (1, 2, 1, "NEW_MEMORY", "", None, "no, we decided to drop it"),
        (1, 2, 1, "QUARANTINE", "LIFECYCLE_TARGET_UNKNOWN", None, "no, we decided to drop it"), (1, 3, 0, "QUARANTINE", "PASTED_OUTPUT", None, "see tool exec result"),
        (2, 0, 0, "QUARANTINE", "SCOPE_UNRESOLVED", None, "we decided to go"), (2, 1, 0, "NEW_MEMORY", "", None, "we decided to stay"),
    }


def test_forms_of_display_and_retention(spark):
    df = spark.createDataFrame([("x" * 50,), ("a\n" * 40,), ("y",)], "content string")
    fitted = [r[0] for r in df.select(reports.fitted(F.col("content"), 45)).collect()]
    room = 45 - len(reports.CUT_MARK)
    assert fitted == ["x" * room + reports.CUT_MARK, ("a\n" * 40)[: ("a\n" * 40).rfind("\n", 0, room)] + reports.CUT_MARK, "y"]
    items = spark.createDataFrame([("PENDING", 0, 10), ("PENDING", 0, 30 * 86400), ("ACCEPTED", 0, 10)], "status string, created_s long, expires_s long")
    assert [tuple(r)[3:] for r in reports.retention(items, 20).collect()] == [(True, 20 + 7 * 86400), (False, None), (False, None)]
