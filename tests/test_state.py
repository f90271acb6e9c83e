"""The replay by segments against one change after the other, with short segments and one busy project."""

import random

import pytest

from memlake.operators import state

CHANGE = "project_id string, ordinal long, operation string, record_id string, target string"


def sequential(changes):
    slots, revisions, out = {}, {}, {}
    for project, ordinal, operation, record, target in sorted(changes, key=lambda c: c[1]):
        kind, op, to = state.OPERATIONS.get(operation, ("unknown", "", ""))
        after = before = ""
        accepted = False
        if kind != "unknown":
            slot = (project, kind) if kind in ("milestone", "objective") else (project, kind, record)
            before = slots.get(slot, "")
            new = state.stepped(kind, before, op, record or "", (to or target or "").upper())
            accepted, after = new is not None, before if new is None else new
            slots[slot] = after
        revisions[project] = revisions.get(project, 0) + accepted
        out[project, ordinal] = (accepted, before, after, revisions[project])
    return out


@pytest.mark.parametrize("segment", [1, 7, 4096])
def test_segments_are_one_fold(spark, segment):
    rng = random.Random(segment)
    names = [*state.OPERATIONS, "TRANSITION_MILESTONE", "TRANSITION_MILESTONE", "NOTHING", None]
    targets = ["ACTIVE", "blocked", "COMPLETED", "CANCELLED", "DONE", "PLANNED", None]
    changes = [("hot" if rng.random() < 0.7 else f"p{rng.randrange(4)}", i, rng.choice(names), rng.choice(["a", "b", "c", "d", "", None]), rng.choice(targets)) for i in range(900)]
    want = sequential(changes)
    got = {(r["project_id"], r["ordinal"]): (r["accepted"], r["before"], r["after"], r["revision"]) for r in state.replayed(spark.createDataFrame(changes, CHANGE).repartition(3), segment).collect()}
    assert got == want
    assert sum(v[0] for v in want.values()) > 100 and sum(not v[0] for v in want.values()) > 100


def test_functions_compose_like_steps():
    """The function of two runs together is that of the second after that of the first, from any state."""
    rng = random.Random(9)
    for kind in ("milestone", "work_item", "requirement", "blocker", "risk", "objective"):
        for _ in range(60):
            run = [(rng.choice(["add", "move"]), rng.choice("xyz"), rng.choice(["ACTIVE", "BLOCKED", "COMPLETED", "DONE", "RESOLVED"])) for _ in range(rng.randrange(12))]
            f = state.Function(kind)
            for change in run:
                f.then(*change)
            starts = ["", "x|ACTIVE", "y|BLOCKED", "w|ACTIVE", "x|COMPLETED"] if kind in ("milestone", "objective") else ["", "ACTIVE", "RESOLVED"]
            for before in starts:
                now = before
                for op, record, target in run:
                    after = state.stepped(kind, now, op, record, target)
                    now = now if after is None else after
                assert state.applied(kind, f.image(), before) == now, (kind, run, before)


def test_nothing_to_replay(spark):
    assert state.replayed(spark.createDataFrame([], CHANGE)).collect() == []


def test_a_milestone_must_end_before_the_next(spark):
    rows = [("p", 1, "SET_CURRENT_PHASE", "m1", None), ("p", 2, "SET_CURRENT_PHASE", "m2", None), ("p", 3, "TRANSITION_MILESTONE", "m2", "COMPLETED"), ("p", 4, "TRANSITION_MILESTONE", "m1", "completed"), ("p", 5, "SET_CURRENT_PHASE", "m2", None), ("p", 6, "TRANSITION_MILESTONE", "m1", "ACTIVE")]
    got = {r["ordinal"]: (r["accepted"], r["revision"]) for r in state.replayed(spark.createDataFrame(rows, CHANGE), 2).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (False, 1), 4: (True, 2), 5: (True, 3), 6: (False, 3)}
