"""Lifecycle of records and entities: decisions on proposals about stored records, their effects, state transitions, upserts and the recap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which state an item may go to from which.
MILESTONE_MOVES = {"PLANNED": ("ACTIVE", "CANCELLED"), "ACTIVE": ("BLOCKED", "COMPLETED", "CANCELLED"), "BLOCKED": ("ACTIVE", "CANCELLED"), "COMPLETED": (), "CANCELLED": ()}
WORK_ITEM_MOVES = {"TODO": ("ACTIVE", "BLOCKED", "DONE", "DROPPED"), "ACTIVE": ("BLOCKED", "DONE", "DROPPED"), "BLOCKED": ("ACTIVE", "DONE", "DROPPED"), "DONE": (), "DROPPED": ()}
STATUSES = ("active", "resolved", "superseded")
RECAP_ROWS = 50


def _holders(records: DataFrame) -> DataFrame:
    """(scope, project_id, claim_key, holder, next_holder): the first two active records of each claim key, in store order."""
    key = ["scope", "project_id", "claim_key"]
    active = records.where("claim_key != '' and status = 'active'").select(*key, F.struct("store_ordinal", "memory_id").alias("r"))
    first = active.groupBy(*key).agg(F.min("r").alias("holder"))
    second = active.join(first, key).where("r != holder").groupBy(*key).agg(F.min("r").alias("next_holder"))
    return first.join(second, key, "left")


def lifecycle_decisions(proposed: DataFrame, records: DataFrame) -> DataFrame:
    """candidate_id, action, reason, target, successor: the decision on each committed proposal, from the store as it is.

    `proposed`: candidate_id, operation, target_id, successor_id, scope, project_id, claim_key, fingerprint, confirms. `records`: memory_id,
    store_ordinal, scope, project_id, claim_key, fingerprint, status. Global rows carry the project ''. A new claim meets the first record
    of its scope that has its fingerprint or is an active holder of its claim key. What meets the proposals is one row per id,
    fingerprint or key, so no group of copies is multiplied.
    """
    target = records.select(F.col("memory_id").alias("target_id"), F.col("scope").alias("t_scope"), F.col("project_id").alias("t_project"), F.col("status").alias("t_status"))
    taken = records.select(F.col("memory_id").alias("successor_id"), F.lit(True).alias("taken"))
    equal = records.groupBy("scope", "project_id", "fingerprint").agg(F.min(F.struct("store_ordinal", "memory_id")).alias("equal"))
    seen = proposed.join(target, "target_id", "left").join(taken, "successor_id", "left").join(equal, ["scope", "project_id", "fingerprint"], "left")
    seen = seen.join(_holders(records), ["scope", "project_id", "claim_key"], "left")
    other = F.when(F.col("holder.memory_id") == F.col("target_id"), F.col("next_holder.memory_id")).otherwise(F.col("holder.memory_id"))
    is_new, supersedes = F.col("operation") == "NEW", F.col("operation") == "SUPERSEDE_EXISTING"
    equal_first = F.col("equal").isNotNull() & (F.col("holder").isNull() | (F.col("equal.store_ordinal") <= F.col("holder.store_ordinal")))
    reason = (
        F.when(is_new & equal_first, "EXACT_SCOPED_FINGERPRINT")
        .when(is_new & F.col("holder").isNotNull(), "ACTIVE_CLAIM_KEY_CONFLICT")
        .when(is_new, "NO_SCOPED_MATCH")
        .when(F.col("t_scope").isNull(), "LIFECYCLE_TARGET_UNKNOWN")
        .when((F.col("t_scope") != F.col("scope")) | (F.col("t_project") != F.col("project_id")), "SCOPE_MISMATCH")
        .when(~F.col("t_status").isin(*STATUSES), "UNKNOWN_LIFECYCLE")
        .when(F.col("operation") == "CONFIRM_EXISTING", "EXPLICIT_CONFIRMATION")
        .when(F.col("t_status") != "active", "TARGET_NOT_ACTIVE")
        .when(supersedes & ((F.col("successor_id") == F.col("target_id")) | F.col("taken").isNotNull()), "SUPERSESSION_CYCLE_OR_DUPLICATE")
        .when(supersedes & other.isNotNull(), "ACTIVE_CLAIM_KEY_CONFLICT")
        .when(supersedes, "EXPLICIT_SUPERSESSION")
        .otherwise("EXPLICIT_LIFECYCLE_MUTATION")
    )
    rated = seen.select("candidate_id", "operation", "confirms", "target_id", "successor_id", F.col("equal.memory_id").alias("equal_id"), F.col("holder.memory_id").alias("holder_id"), other.alias("other_id"), reason.alias("reason"))
    action = (
        F.when(F.col("reason") == "EXACT_SCOPED_FINGERPRINT", F.when(F.col("confirms"), "CONFIRM_EXISTING").otherwise("DUPLICATE"))
        .when(F.col("reason") == "ACTIVE_CLAIM_KEY_CONFLICT", "CONFLICT")
        .when(F.col("reason").isin("NO_SCOPED_MATCH", "EXPLICIT_CONFIRMATION", "EXPLICIT_SUPERSESSION", "EXPLICIT_LIFECYCLE_MUTATION"), F.col("operation"))
        .otherwise("REVIEW_REQUIRED")
    )
    met = F.when(F.col("reason") == "EXACT_SCOPED_FINGERPRINT", F.col("equal_id")).when(F.col("reason") == "ACTIVE_CLAIM_KEY_CONFLICT", F.when(is_new, F.col("holder_id")).otherwise(F.col("other_id")))
    met = met.when((F.col("reason") == "NO_SCOPED_MATCH") | (F.col("reason") == "LIFECYCLE_TARGET_UNKNOWN"), "").otherwise(F.col("target_id"))
    return rated.select("candidate_id", action.alias("action"), "reason", met.alias("target"), F.when(F.col("reason") == "EXPLICIT_SUPERSESSION", F.col("successor_id")).otherwise("").alias("successor"))


def committed(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """memory_id, status, superseded_by after the decisions (ordinal, action, target, successor, fingerprint, scope, project_id).

    The last decision on a record gives its status, the last supersession its successor. Successors enter as active, and so does the first
    new proposal of a fingerprint, under the successor's id.
    """
    moved = F.when(F.col("action") == "SUPERSEDE_EXISTING", "superseded").otherwise("resolved")
    effects = decisions.where(F.col("action").isin("SUPERSEDE_EXISTING", "RESOLVE_EXISTING")).groupBy(F.col("target").alias("memory_id")).agg(
        F.max(F.struct("ordinal", moved.alias("status"))).alias("last"),
        F.max(F.when(F.col("action") == "SUPERSEDE_EXISTING", F.struct("ordinal", "successor"))).alias("by"),
    )
    kept = records.select("memory_id", "status", "superseded_by").join(effects, "memory_id", "left")
    kept = kept.select("memory_id", F.coalesce("last.status", "status").alias("status"), F.coalesce("by.successor", "superseded_by").alias("superseded_by"))
    fresh = decisions.where("action = 'NEW'").groupBy("scope", "project_id", "fingerprint").agg(F.min(F.struct("ordinal", "successor")).alias("x")).select(F.col("x.successor").alias("memory_id"))
    entering = decisions.where("action = 'SUPERSEDE_EXISTING'").select(F.col("successor").alias("memory_id")).union(fresh)
    return kept.union(entering.select("memory_id", F.lit("active"), F.lit("")))


def may_move(moves: dict[str, tuple[str, ...]], before: Column, after: Column) -> Column:
    """Whether an item may go from one state to the other; null states may not."""
    allowed = F.lit(False)
    for state, following in moves.items():
        if following:
            allowed = allowed | ((before == state) & after.isin(*following))
    return F.coalesce(allowed, F.lit(False))


def broken_revisions(events: DataFrame) -> DataFrame:
    """(event_id, problem) of state events (event_id, project_id, old_revision, new_revision) that no replay can apply: 'step' if the revision
    does not grow by one, 'fork' if an earlier event id starts at the same revision, 'gap' if no event leads to where it starts.

    Each event meets one row per project and revision, so a project with most of the events is spread by its revisions.
    """
    start = events.groupBy("project_id", "old_revision").agg(F.min("event_id").alias("first"))
    reached = events.where("new_revision = old_revision + 1").select("project_id", F.col("new_revision").alias("old_revision"), F.lit(True).alias("reached")).distinct()
    met = events.join(start, ["project_id", "old_revision"]).join(reached, ["project_id", "old_revision"], "left")
    problem = (
        F.when(F.col("new_revision") != F.col("old_revision") + 1, "step")
        .when(F.col("event_id") != F.col("first"), "fork")
        .when((F.col("old_revision") != 0) & F.col("reached").isNull(), "gap")
    )
    return met.select("event_id", problem.alias("problem")).where("problem is not null")


def upserted_entities(upserts: DataFrame) -> DataFrame:
    """(entity, type, name, created, properties) after all upserts (ordinal, entity, type, name, properties as a map): the last name and type,
    the first ordinal, and of each property the last value, as a map. Properties are reduced by key before an entity gathers them."""
    last = upserts.groupBy("entity").agg(F.max(F.struct("ordinal", "type", "name")).alias("x"), F.min("ordinal").alias("created"))
    single = upserts.select("entity", "ordinal", F.explode("properties").alias("k", "v")).groupBy("entity", "k").agg(F.max(F.struct("ordinal", "v")).alias("p"))
    merged = single.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "p.v")))).alias("properties"))
    return last.join(merged, "entity", "left").select("entity", "x.type", "x.name", "created", "properties")


def visible(kind: Column, scope: Column, owner: Column, project: str, retrieval: str) -> Column:
    """Whether a graph node is seen from a project: its own project's node, records by their scope, and all shared nodes."""
    if retrieval == "all":
        return F.lit(True)
    of_project = (scope == "project") & (owner == project) & F.lit(project != "")
    record = {"global": scope == "global", "project": of_project}.get(retrieval, (scope == "global") | of_project)
    return F.when(kind == "PROJECT", (owner == project) & F.lit(project != "" and retrieval != "global")).when(kind == "MEMORY", record).otherwise(True)


def induced_edges(own_edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges between nodes of `chosen` (node)."""
    ends = chosen.select("node").distinct()
    return own_edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def recap(items: DataFrame, start: int, end: int, rows: int = RECAP_ROWS) -> DataFrame:
    """The first `rows` of the items (label, kind, id, first_s, last_s) in the window [start, end): by label, then receipts, sessions and
    memories, the latest first. The limit is the feature; it is taken per task before the rest meets."""
    rank = F.when(F.col("kind") == "receipt", 0).when(F.col("kind") == "session", 1).otherwise(2)
    return items.where((F.col("first_s") < end) & (F.col("last_s") >= start)).orderBy("label", rank, F.desc("last_s"), "id").limit(rows)
