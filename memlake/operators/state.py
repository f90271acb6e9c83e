"""Project state: which proposals may change it, a replay of all changes, and the state that comes out.

A change acts on one slot of a project: a work item, a requirement, the current milestone and so on. What a run of changes does to a slot is
a function from the slot's state before it to its state after it, and such functions compose. So the replay reduces each slot's changes in
segments of SEGMENT ordinals to one function each, folds the few functions of a slot, and then applies each segment again from the state
that it starts with. A project that has most of the changes is spread over tasks by slot and segment; only functions, one a segment, meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import MILESTONE_MOVES, WORK_ITEM_MOVES

SEGMENT = 4096
STALE_AFTER_DAYS = 30

#: The changes a project's state knows, as (slot kind, whether it adds or moves, where it moves to).
OPERATIONS = {
    "SET_CURRENT_PHASE": ("milestone", "add", ""), "TRANSITION_MILESTONE": ("milestone", "move", ""), "SET_OBJECTIVE": ("objective", "add", ""),
    "ADD_REQUIREMENT": ("requirement", "add", ""), "RESOLVE_REQUIREMENT": ("requirement", "move", "RESOLVED"), "CANCEL_REQUIREMENT": ("requirement", "move", "CANCELLED"),
    "ADD_WORK_ITEM": ("work_item", "add", ""), "TRANSITION_WORK_ITEM": ("work_item", "move", ""), "ADD_BLOCKER": ("blocker", "add", ""), "RESOLVE_BLOCKER": ("blocker", "move", "RESOLVED"),
    "ADD_CONSTRAINT": ("constraint", "add", ""), "ADD_RISK": ("risk", "add", ""), "ADD_MEMORY_REFERENCE": ("reference", "add", ""),
}
#: What the boundary takes from an extraction, and from whom.
BOUNDARY_OPERATIONS = ("ADD_BLOCKER", "RESOLVE_BLOCKER", "ADD_WORK_ITEM", "SET_OBJECTIVE", "SET_CURRENT_PHASE", "ADD_REQUIREMENT", "RESOLVE_REQUIREMENT")
TRUSTED, COMMITMENTS = ("user", "system", "tool"), ("COMMITTED", "OBSERVED")
PHASE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:phase|faz|aşama)[ \t]*[- ]?([0-9]+[A-Za-z]?)(?:$|[^\p{L}\p{N}_])"
REFERENCED = ("active", "resolved", "superseded")

#: The moves of the slots that hold one record each, and the state an addition gives.
MOVES = {"work_item": WORK_ITEM_MOVES, "requirement": {"ACTIVE": ("RESOLVED", "CANCELLED")}, "blocker": {"ACTIVE": ("RESOLVED",)}, "constraint": {}, "risk": {}, "reference": {}}
ADDED = {"work_item": "TODO"}
OPEN_MILESTONE = tuple(s for s, following in MILESTONE_MOVES.items() if following)


def _closed(state: str) -> bool:
    """Whether a milestone slot takes a new milestone: nothing in it, or something terminal."""
    return state.rpartition("|")[2] not in OPEN_MILESTONE


def stepped(kind: str, state: str, op: str, record: str, target: str) -> str | None:
    """The state of a slot after one change, null if it is refused. A slot of records has a status or ''; milestones and objectives share
    one slot of a project, whose state is `id|status` or ''."""
    if kind == "objective":
        return f"{record}|ACTIVE"
    if kind == "milestone":
        if op == "add":
            return f"{record}|ACTIVE" if _closed(state) else None
        held, _, status = state.rpartition("|")
        return f"{record}|{target}" if held == record and target in MILESTONE_MOVES.get(status, ()) else None
    if op == "add":
        return None if state else ADDED.get(kind, "ACTIVE")
    return target if target in MOVES[kind].get(state, ()) else None


class Function:
    """What a run of changes does to a slot: `image` maps states before to states after; a state it does not name stays as it is.

    Of a milestone slot, '' stands for every state that takes a new milestone, and an open milestone is named once a change moves it:
    until then nothing in the run could have touched it. States that have become one are moved on together."""

    def __init__(self, kind: str):
        self.kind = kind
        states = {"": [""]} if kind in ("milestone", "objective") else {s: [s] for s in ("", ADDED.get(kind, "ACTIVE"), *MOVES[kind], *(t for f in MOVES[kind].values() for t in f))}
        self.at: dict[str, list[str]] = states
        self.named = set(states)

    def then(self, op: str, record: str, target: str) -> None:
        if self.kind == "milestone" and op == "move":
            for status in OPEN_MILESTONE:
                state = f"{record}|{status}"
                if state not in self.named:
                    self.named.add(state)
                    self.at.setdefault(state, []).append(state)
            touched = [s for s in (f"{record}|{status}" for status in OPEN_MILESTONE) if s in self.at]
        elif self.kind == "milestone":
            touched = [s for s in self.at if _closed(s)]
        else:
            touched = list(self.at)
        moved = [(s, stepped(self.kind, s, op, record, target)) for s in touched]
        taken = [(after, self.at.pop(s)) for s, after in moved if after is not None]
        for after, inputs in taken:
            held = self.at.setdefault(after, inputs)
            if held is not inputs:
                self.at[after] = held + inputs if len(held) >= len(inputs) else inputs + held

    def image(self) -> dict[str, str]:
        return {before: after for after, inputs in self.at.items() for before in inputs}


def applied(kind: str, image: dict[str, str], state: str) -> str:
    """The state after a run of changes with this image."""
    if kind in ("milestone", "objective"):
        if kind == "objective" or _closed(state):
            return image[""] or state
        return image.get(state, state)
    return image.get(state, state)


def _streamed(frames: Iterator[pd.DataFrame], key: list[str], begin: Callable, row: Callable, end: Callable) -> Iterator[pd.DataFrame]:
    """Rows in the order of `key`, group after group, with one value of state in hand; groups may span frames."""
    held, state = None, None
    for frame in frames:
        out: list = []
        for r in frame.itertuples(index=False):
            own = tuple(getattr(r, k) for k in key)
            if own != held:
                if held is not None:
                    end(held, state, out)
                held, state = own, begin(r)
            state = row(state, r, out)
        if out:
            yield pd.DataFrame(out)
    if held is not None:
        out = []
        end(held, state, out)
        if out:
            yield pd.DataFrame(out)


_SLOT = ["project_id", "slot"]
_KEY = "project_id string, kind string, slot string, segment long"


def segment_functions(changes: DataFrame) -> DataFrame:
    """(project_id, kind, slot, segment, image): the function of each slot's changes in each segment."""

    def composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(state, r, out):
            state.then(r.op, r.record, r.target)
            return state

        def end(key, state, out):
            out.append({"project_id": key[0], "kind": state.kind, "slot": key[1], "segment": key[2], "image": state.image()})

        return _streamed(frames, [*_SLOT, "segment"], lambda r: Function(r.kind), row, end)

    ordered = changes.repartition(*_SLOT, "segment").sortWithinPartitions(*_SLOT, "segment", "ordinal")
    return ordered.mapInPandas(composed, f"{_KEY}, image map<string, string>")


def segment_starts(functions: DataFrame, initial: str = "") -> DataFrame:
    """(project_id, kind, slot, segment, before): the state that each segment starts with. One row a segment and slot is all that meets."""

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(state, r, out):
            out.append({"project_id": r.project_id, "kind": r.kind, "slot": r.slot, "segment": r.segment, "before": state})
            return applied(r.kind, dict(r.image), state)

        return _streamed(frames, _SLOT, lambda r: initial, row, lambda *_: None)

    return functions.repartition(*_SLOT).sortWithinPartitions(*_SLOT, "segment").mapInPandas(folded, f"{_KEY}, before string")


def replayed(changes: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(project_id, ordinal, kind, slot, record, accepted, before, after, revision): every change in the order of its project's ordinals,
    whether it was accepted, the slot's state before and after it, and the project's revision after it (a refused change leaves it).

    `changes`: project_id, ordinal (long, unique in a project), operation, record_id, target (the status a transition asks for). Unknown
    operations are refused as they are. Equal to applying one change after the other.
    """
    kinds = F.create_map(*[F.lit(x) for name, v in OPERATIONS.items() for x in (name, v[0])])
    ops = F.create_map(*[F.lit(x) for name, v in OPERATIONS.items() for x in (name, v[1])])
    targets = F.create_map(*[F.lit(x) for name, v in OPERATIONS.items() for x in (name, v[2])])
    op = F.col("operation")
    whole = F.element_at(kinds, op).isin("milestone", "objective")
    rows = changes.select(
        "project_id", "ordinal", F.floor(F.col("ordinal") / segment).cast("long").alias("segment"), F.coalesce(F.element_at(kinds, op), F.lit("unknown")).alias("kind"),
        F.coalesce(F.element_at(ops, op), F.lit("")).alias("op"), F.coalesce("record_id", F.lit("")).alias("record"),
        F.upper(F.coalesce(F.nullif(F.element_at(targets, op), F.lit("")), F.col("target"), F.lit(""))).alias("target"),
        F.when(whole, F.element_at(kinds, op)).otherwise(F.concat_ws(":", F.element_at(kinds, op), "record_id")).alias("slot"),
    )
    known = rows.where("kind != 'unknown'")
    starts = segment_starts(segment_functions(known))

    def rerun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(state, r, out):
            if r.before is not None:  # the segment's own row, which comes first
                return r.before
            after = stepped(r.kind, state, r.op, r.record, r.target)
            out.append({"project_id": r.project_id, "ordinal": r.ordinal, "segment": r.segment, "kind": r.kind, "slot": r.slot, "record": r.record, "accepted": after is not None, "before": state, "after": state if after is None else after})
            return state if after is None else after

        return _streamed(frames, [*_SLOT, "segment"], lambda r: None, row, lambda *_: None)

    heads = starts.select("project_id", F.lit(None).cast("long").alias("ordinal"), "segment", "kind", F.lit("").alias("op"), F.lit("").alias("record"), F.lit("").alias("target"), "slot", "before")
    both = heads.unionByName(known.withColumn("before", F.lit(None).cast("string")))
    ordered = both.repartition(*_SLOT, "segment").sortWithinPartitions(*_SLOT, "segment", F.asc_nulls_first("ordinal"))
    done = ordered.mapInPandas(rerun, "project_id string, ordinal long, segment long, kind string, slot string, record string, accepted boolean, before string, after string")
    refused = rows.where("kind = 'unknown'").select("project_id", "ordinal", "segment", "kind", F.lit("").alias("slot"), "record", F.lit(False).alias("accepted"), F.lit("").alias("before"), F.lit("").alias("after"))
    return _with_revision(done.unionByName(refused))


def _with_revision(done: DataFrame) -> DataFrame:
    """The running number of accepted changes of a project: sums within its segments, and the few sums of its segments before them."""
    per = done.groupBy("project_id", "segment").agg(F.count_if("accepted").alias("own"))
    before = per.select("project_id", "segment", (F.sum("own").over(Window.partitionBy("project_id").orderBy("segment")) - F.col("own")).alias("base"))
    within = F.sum(F.col("accepted").cast("long")).over(Window.partitionBy("project_id", "segment").orderBy("ordinal"))
    return done.withColumn("within", within).join(before, ["project_id", "segment"]).select("project_id", "ordinal", "kind", "slot", "record", "accepted", "before", "after", (F.col("base") + F.col("within")).alias("revision"))


def final_slots(replay: DataFrame) -> DataFrame:
    """(project_id, kind, slot, record, status, changed): each slot's last state; of milestones and objectives the record in it."""
    last = replay.where("accepted").groupBy("project_id", "kind", "slot").agg(F.max(F.struct("ordinal", "after", "record")).alias("x"))
    single = F.col("kind").isin("milestone", "objective")
    status = F.when(single, F.substring_index("x.after", "|", -1)).otherwise(F.col("x.after"))
    return last.select("project_id", "kind", "slot", F.col("x.record").alias("record"), status.alias("status"), F.col("x.ordinal").alias("changed"))


def reference_health(slots: DataFrame, records: DataFrame) -> DataFrame:
    """(project_id, record, health) of the memory references of each project: valid, dangling (no such record, or one of an unusable
    status) or wrong_project."""
    held = slots.where("kind = 'reference'").select("project_id", "record")
    own = records.select(F.col("memory_id").alias("record"), F.col("status").alias("r_status"), "scope", F.col("project_id").alias("r_project"))
    met = held.join(own, "record", "left")
    health = (
        F.when(F.col("scope").isNull() | ~F.coalesce("r_status", F.lit("active")).isin(*REFERENCED), "dangling")
        .when((F.col("scope") == "global") | ((F.col("scope") == "project") & (F.col("r_project") == F.col("project_id"))), "valid")
        .otherwise("wrong_project")
    )
    return met.select("project_id", "record", health.alias("health"))


def resolved(replay: DataFrame, projects: DataFrame, records: DataFrame, times: DataFrame, as_of: int, stale_after_days: int = STALE_AFTER_DAYS) -> DataFrame:
    """The current state of each registered project (project_id, status): how it is available, its revision and age, the open milestone's
    record as phase, milestone, objective, and the numbers of open requirements, work items and blockers, of constraints and risks, and of
    references by health. `times`: project_id, ordinal, at_s of the changes."""
    slots = final_slots(replay)
    kind, status = F.col("kind"), F.col("status")
    of = lambda k, *states: F.count_if((kind == k) & (status.isin(*states) if states else F.lit(True)))
    one = lambda k, c: F.max(F.when(kind == k, F.col(c)))
    summary = slots.groupBy("project_id").agg(
        one("milestone", "record").alias("milestone"), one("milestone", "status").alias("milestone_status"), one("objective", "record").alias("objective"),
        of("requirement", "ACTIVE").alias("requirements"), of("work_item", "TODO", "ACTIVE", "BLOCKED").alias("work_items"), of("blocker", "ACTIVE").alias("blockers"), of("constraint").alias("constraints"), of("risk").alias("risks"),
    )
    health = reference_health(slots, records).groupBy("project_id").agg(*[F.count_if(F.col("health") == h).alias(h) for h in ("valid", "dangling", "wrong_project")])
    last = replay.where("accepted").join(times, ["project_id", "ordinal"]).groupBy("project_id").agg(F.max("revision").alias("revision"), F.max_by("at_s", "ordinal").alias("updated"))
    met = projects.select("project_id", F.col("status").alias("registered")).join(last, "project_id", "left").join(summary, "project_id", "left").join(health, "project_id", "left")
    age = F.greatest(F.lit(0), F.floor((F.lit(as_of) - F.col("updated")) / 86400))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    available = F.when(F.col("registered") == "archived", "PROJECT_ARCHIVED").when(F.col("revision").isNull(), "STATE_NOT_FOUND").otherwise("STATE_AVAILABLE")
    return met.select(
        "project_id", available.alias("status"), "revision", age.alias("age_days"), F.when(age >= stale_after_days, "stale_candidate").when(age.isNotNull(), "current").alias("freshness"),
        F.when(F.col("milestone_status").isin(*OPEN_MILESTONE), F.col("milestone")).alias("phase"), "milestone", "milestone_status", "objective",
        *map(count, ("requirements", "work_items", "blockers", "constraints", "risks", "valid", "dangling", "wrong_project")),
    )


def boundary_reason(phase: Column) -> Column:
    """Why a proposal never reaches its project's state, null if it does. Of what comes first, the first holds."""
    c, missing = F.col, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return (
        F.when(missing(c("candidate_id")) | missing(c("candidate_type")), "INVALID_CANDIDATE")
        .when(c("candidate_type") == "NEW_MEMORY", F.when(c("memory_type") == "open_loop", "OPEN_LOOP_TO_MEMORY").otherwise("MEMORY_TO_MEMORYSTORE"))
        .when(c("candidate_type") != "STATE_MUTATION", "UNSUPPORTED_CANDIDATE_TYPE")
        .when(missing(c("project_id")), "PROJECT_UNRESOLVED")
        .when(~F.coalesce(c("commitment").isin(*COMMITMENTS), F.lit(False)), "UNTRUSTED_COMMITMENT")
        .when(~F.coalesce(c("source_type").isin(*TRUSTED), F.lit(False)), "INVALID_PROVENANCE")
        .when(c("registered").isNull(), "PROJECT_UNKNOWN")
        .when(c("registered") == "archived", "PROJECT_ARCHIVED")
        .when(missing(c("text")), "TEXT_REQUIRED")
        .when(~F.coalesce(c("operation").isin(*BOUNDARY_OPERATIONS), F.lit(False)), "UNSUPPORTED_STATE_OPERATION")
        .when(c("operation").isin("RESOLVE_BLOCKER", "RESOLVE_REQUIREMENT") & missing(c("record_id")), "LIFECYCLE_TARGET_REQUIRED")
        .when((c("operation") == "SET_CURRENT_PHASE") & (phase == ""), "PHASE_TARGET_REQUIRED")
    )


#: The status that goes with each reason.
BOUNDARY_STATUS = {
    "OPEN_LOOP_TO_MEMORY": "SKIPPED", "MEMORY_TO_MEMORYSTORE": "SKIPPED", "PROJECT_UNRESOLVED": "SCOPE_ERROR", "PROJECT_UNKNOWN": "SCOPE_ERROR", "PROJECT_ARCHIVED": "SCOPE_ERROR",
    "UNTRUSTED_COMMITMENT": "REVIEW_REQUIRED", "INVALID_PROVENANCE": "REVIEW_REQUIRED", "LIFECYCLE_TARGET_REQUIRED": "REVIEW_REQUIRED", "PHASE_TARGET_REQUIRED": "REVIEW_REQUIRED",
}


def applied_batch(proposals: DataFrame, projects: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(candidate_id, status, reason, phase_id, revision_before, revision_after) of each proposal, applied in the order of its project's
    ordinals, each to the state that those before it left; revisions of what reached a state only.

    `proposals`: ordinal, candidate_id, candidate_type, memory_type, project_id, commitment, source_type, operation, record_id, text, target.
    An addition's record is `record_id`; one that is already there is refused.
    """
    own = projects.select(F.col("project_id"), F.col("status").alias("registered"))
    number = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), PHASE, 1))
    rated = proposals.join(own, "project_id", "left").withColumn("phase", number)
    rated = rated.withColumn("reason", boundary_reason(F.col("phase")))
    reached = rated.where("reason is null").select("project_id", "ordinal", "operation", "record_id", "target")
    done = replayed(reached, segment).select("project_id", "ordinal", "accepted", "revision")
    met = rated.join(done, ["project_id", "ordinal"], "left")
    refused = F.when(F.col("operation").startswith("ADD_"), "STATE_MUTATION_FAILED").otherwise("INVALID_TRANSITION")
    reason = F.coalesce("reason", F.when(F.col("accepted"), "STATE_MUTATION_COMMITTED").otherwise(refused))
    fixed = F.create_map(*[F.lit(x) for pair in BOUNDARY_STATUS.items() for x in pair])
    status = F.coalesce(F.element_at(fixed, reason), F.when(F.col("accepted"), "SUCCESS").otherwise("FAILED"))
    step = F.when(F.col("accepted"), 1).otherwise(0)
    phase_id = F.when(F.col("accepted") & (F.col("operation") == "SET_CURRENT_PHASE"), F.concat(F.lit("phase-"), "phase"))
    return met.select("candidate_id", status.alias("status"), reason.alias("reason"), phase_id.alias("phase_id"), (F.col("revision") - step).alias("revision_before"), F.when(F.col("accepted"), F.col("revision")).alias("revision_after"))
