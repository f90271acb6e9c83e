"""The registered queries of `memlake.operators.state`, each beside its DuckDB SQL: the changes one after the other, by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import state
from memlake.sources import views
from memlake.sources.views import AS_OF, table

from .queries import query
from .upkeep import derived, sql_view

_OPS = ("SET_CURRENT_PHASE", "TRANSITION_MILESTONE", "SET_OBJECTIVE", "ADD_REQUIREMENT", "RESOLVE_REQUIREMENT", "CANCEL_REQUIREMENT", "ADD_WORK_ITEM", "TRANSITION_WORK_ITEM", "ADD_BLOCKER", "RESOLVE_BLOCKER", "ADD_CONSTRAINT", "ADD_RISK", "ADD_MEMORY_REFERENCE", "RENAME", "TRANSITION_WORK_ITEM", "TRANSITION_MILESTONE")
#: Proposals for the state of projects, a third of them for one, alike in Spark and in SQL.
PROPOSAL = {
    "ordinal": "event_id",
    "candidate_id": "CASE WHEN event_id % 211 = 0 THEN '' ELSE concat('c', CAST(event_id AS STRING)) END",
    "candidate_type": "CASE WHEN event_id % 41 = 0 THEN 'NEW_MEMORY' WHEN event_id % 43 = 0 THEN 'OTHER' ELSE 'STATE_MUTATION' END",
    "memory_type": "CASE WHEN event_id % 2 = 0 THEN 'open_loop' ELSE 'lesson' END",
    "project_id": "CASE WHEN event_id % 3 = 0 THEN 'p_en' WHEN event_id % 47 = 0 THEN '' WHEN user_id % 5 = 0 THEN 'p_de' WHEN user_id % 5 = 1 THEN 'p_fr' WHEN user_id % 5 = 2 THEN 'p_es' WHEN user_id % 5 = 3 THEN 'p_none' ELSE 'p_de' END",
    "commitment": "CASE WHEN event_id % 17 = 0 THEN 'TENTATIVE' WHEN event_id % 5 = 0 THEN 'OBSERVED' ELSE 'COMMITTED' END",
    "source_type": "CASE WHEN event_id % 29 = 0 THEN 'ai_proposed' WHEN event_id % 2 = 0 THEN 'user' ELSE 'tool' END",
    "operation": "CASE (event_id * 7 + user_id) % 16 " + " ".join(f"WHEN {k} THEN '{o}'" for k, o in enumerate(_OPS)) + " END",
    "target": "CASE event_id % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'blocked' WHEN 2 THEN 'DONE' WHEN 3 THEN 'COMPLETED' ELSE 'CANCELLED' END",
    "text": "CASE WHEN event_id % 37 = 0 THEN ' ' WHEN event_id % 4 = 0 THEN concat('Faz-', CAST(event_id % 9 AS STRING), 'B begins') WHEN event_id % 4 = 1 THEN concat('now in phase ', CAST(event_id % 9 AS STRING)) ELSE 'phases to come' END",
    "number": "(event_id * 31 + user_id * 17) % 97",
    "record_id": "CASE WHEN (event_id * 7 + user_id) % 16 IN (0, 1, 15) THEN concat('mil_', CAST(event_id % 3 AS STRING)) WHEN (event_id * 7 + user_id) % 16 = 12 THEN concat('mem_', lpad(CAST(event_id * 3 % 1300 AS STRING), 8, '0')) WHEN event_id % 31 = 0 THEN '' ELSE concat('rec_', CAST((event_id * 31 + user_id * 17) % 97 AS STRING)) END",
}
_OPERATION_SQL = "(VALUES " + ", ".join(f"('{name}', '{k}', '{op}', '{to}')" for name, (k, op, to) in state.OPERATIONS.items()) + ") AS known(operation, kind, op, fixed)"
_NEXT = """CASE WHEN c.kind = 'objective' THEN c.record || '|ACTIVE'
  WHEN c.kind = 'milestone' AND c.op = 'add' THEN CASE WHEN split_part(f.after, '|', 2) NOT IN ('PLANNED', 'ACTIVE', 'BLOCKED') THEN c.record || '|ACTIVE' END
  WHEN c.kind = 'milestone' THEN CASE WHEN split_part(f.after, '|', 1) = c.record AND (split_part(f.after, '|', 2), c.target) IN (('PLANNED', 'ACTIVE'), ('PLANNED', 'CANCELLED'), ('ACTIVE', 'BLOCKED'), ('ACTIVE', 'COMPLETED'), ('ACTIVE', 'CANCELLED'), ('BLOCKED', 'ACTIVE'), ('BLOCKED', 'CANCELLED')) THEN c.record || '|' || c.target END
  WHEN c.op = 'add' THEN CASE WHEN f.after = '' THEN CASE c.kind WHEN 'work_item' THEN 'TODO' ELSE 'ACTIVE' END END
  WHEN c.kind = 'work_item' THEN CASE WHEN (f.after, c.target) IN (('TODO', 'ACTIVE'), ('TODO', 'BLOCKED'), ('TODO', 'DONE'), ('TODO', 'DROPPED'), ('ACTIVE', 'BLOCKED'), ('ACTIVE', 'DONE'), ('ACTIVE', 'DROPPED'), ('BLOCKED', 'ACTIVE'), ('BLOCKED', 'DONE'), ('BLOCKED', 'DROPPED')) THEN c.target END
  WHEN f.after = 'ACTIVE' AND (c.kind, c.target) IN (('requirement', 'RESOLVED'), ('requirement', 'CANCELLED'), ('blocker', 'RESOLVED')) THEN c.target END"""


def _replay_sql(of: str) -> str:
    """CTEs up to `replay`, the changes of `of` applied one after the other in each slot."""
    return f"""coded AS (SELECT o.project_id, o.ordinal, coalesce(known.kind, 'unknown') AS kind, known.op, coalesce(o.record_id, '') AS record, upper(CASE WHEN known.fixed <> '' THEN known.fixed ELSE coalesce(o.target, '') END) AS target,
  CASE WHEN known.kind IN ('milestone', 'objective') THEN known.kind WHEN known.kind IS NULL THEN '' ELSE known.kind || ':' || o.record_id END AS slot FROM {of} o LEFT JOIN {_OPERATION_SQL} ON known.operation = o.operation),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, slot ORDER BY ordinal) AS nr FROM coded WHERE kind <> 'unknown'),
 folded(project_id, slot, nr, ordinal, kind, record, before, after, accepted) AS (
  SELECT DISTINCT project_id, slot, 0::BIGINT, NULL::BIGINT, '', '', '', '', false FROM numbered
  UNION ALL SELECT project_id, slot, nr, ordinal, kind, record, before, coalesce(following, before), following IS NOT NULL FROM (
   SELECT c.project_id, c.slot, c.nr, c.ordinal, c.kind, c.record, f.after AS before, {_NEXT} AS following FROM folded f JOIN numbered c ON c.project_id = f.project_id AND c.slot = f.slot AND c.nr = f.nr + 1)),
 every AS (SELECT project_id, ordinal, kind, slot, record, accepted, before, after FROM folded WHERE nr > 0 UNION ALL SELECT project_id, ordinal, kind, '', record, false, '', '' FROM coded WHERE kind = 'unknown'),
 replay AS (SELECT *, sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY ordinal)::BIGINT AS revision FROM every)"""


_PROPOSALS = sql_view("proposals", PROPOSAL, "events")
_REPLAY = f"WITH RECURSIVE {_PROPOSALS}, {_replay_sql('proposals')}"


def _proposals(spark, sf_dir):
    return derived(table(spark, sf_dir, "events"), PROPOSAL)


def _replayed(spark, sf_dir):
    return state.replayed(_proposals(spark, sf_dir).select("project_id", "ordinal", "operation", "record_id", "target"))


@query(f"{_REPLAY} SELECT * FROM replay")
def state_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


_SLOTS = "slots AS (SELECT project_id, kind, slot, arg_max(record, ordinal) AS record, CASE WHEN kind IN ('milestone', 'objective') THEN split_part(arg_max(after, ordinal), '|', 2) ELSE arg_max(after, ordinal) END AS status, max(ordinal) AS changed FROM replay WHERE accepted GROUP BY project_id, kind, slot)"


@query(f"{_REPLAY}, {_SLOTS} SELECT * FROM slots")
def state_slots(spark, sf_dir):
    return state.final_slots(_replayed(spark, sf_dir))


_HEALTH = """health AS (SELECT s.project_id, s.record, CASE WHEN m.memory_id IS NULL OR m.status NOT IN ('active', 'resolved', 'superseded') THEN 'dangling' WHEN m.scope = 'global' OR m.project_id = s.project_id THEN 'valid' ELSE 'wrong_project' END AS health
 FROM slots s LEFT JOIN memories m ON m.memory_id = s.record WHERE s.kind = 'reference')"""
_VIEWED = f"{views.with_views('memories', 'projects')}, {_PROPOSALS}, {_replay_sql('proposals')}, {_SLOTS}, {_HEALTH}"


@query(f"{_VIEWED} SELECT * FROM health")
def state_references(spark, sf_dir):
    return state.reference_health(state.final_slots(_replayed(spark, sf_dir)), views.memories(spark, sf_dir))


@query(f"""{_VIEWED}, last AS (SELECT r.project_id, max(r.revision) AS revision, arg_max(CAST(floor(epoch(e.ts)) AS BIGINT), r.ordinal) AS updated FROM replay r JOIN events e ON e.event_id = r.ordinal WHERE r.accepted GROUP BY 1),
 summed AS (SELECT project_id, max(record) FILTER (kind = 'milestone') AS milestone, max(status) FILTER (kind = 'milestone') AS milestone_status, max(record) FILTER (kind = 'objective') AS objective, count(*) FILTER (kind = 'requirement' AND status = 'ACTIVE') AS requirements,
  count(*) FILTER (kind = 'work_item' AND status IN ('TODO', 'ACTIVE', 'BLOCKED')) AS work_items, count(*) FILTER (kind = 'blocker' AND status = 'ACTIVE') AS blockers, count(*) FILTER (kind = 'constraint') AS constraints, count(*) FILTER (kind = 'risk') AS risks FROM slots GROUP BY 1),
 h AS (SELECT project_id, count(*) FILTER (health = 'valid') AS valid, count(*) FILTER (health = 'dangling') AS dangling, count(*) FILTER (health = 'wrong_project') AS wrong_project FROM health GROUP BY 1)
SELECT p.project_id, CASE WHEN p.status = 'archived' THEN 'PROJECT_ARCHIVED' WHEN l.revision IS NULL THEN 'STATE_NOT_FOUND' ELSE 'STATE_AVAILABLE' END AS status, l.revision, greatest(0, CAST(floor(({AS_OF} - l.updated) / 86400) AS BIGINT)) AS age_days,
 CASE WHEN l.updated IS NULL THEN NULL WHEN greatest(0, floor(({AS_OF} - l.updated) / 86400)) >= 30 THEN 'stale_candidate' ELSE 'current' END AS freshness, CASE WHEN s.milestone_status IN ('PLANNED', 'ACTIVE', 'BLOCKED') THEN s.milestone END AS phase, s.milestone, s.milestone_status, s.objective,
 {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('requirements', 'work_items', 'blockers', 'constraints', 'risks', 'valid', 'dangling', 'wrong_project'))}
FROM projects p LEFT JOIN last l USING (project_id) LEFT JOIN summed s USING (project_id) LEFT JOIN h USING (project_id)""")
def state_resolve(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    times = derived(events, PROPOSAL).select("project_id", "ordinal", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"))
    return state.resolved(_replayed(spark, sf_dir), views.projects(spark, sf_dir), views.memories(spark, sf_dir), times, AS_OF)


_BLANK = "trim(coalesce({}, '')) = ''".format
_REASON = f"""CASE WHEN {_BLANK('candidate_id')} OR {_BLANK('candidate_type')} THEN 'INVALID_CANDIDATE' WHEN candidate_type = 'NEW_MEMORY' THEN CASE WHEN memory_type = 'open_loop' THEN 'OPEN_LOOP_TO_MEMORY' ELSE 'MEMORY_TO_MEMORYSTORE' END
 WHEN candidate_type <> 'STATE_MUTATION' THEN 'UNSUPPORTED_CANDIDATE_TYPE' WHEN {_BLANK('project_id')} THEN 'PROJECT_UNRESOLVED' WHEN commitment NOT IN ('COMMITTED', 'OBSERVED') THEN 'UNTRUSTED_COMMITMENT' WHEN source_type NOT IN ('user', 'system', 'tool') THEN 'INVALID_PROVENANCE'
 WHEN registered IS NULL THEN 'PROJECT_UNKNOWN' WHEN registered = 'archived' THEN 'PROJECT_ARCHIVED' WHEN {_BLANK('text')} THEN 'TEXT_REQUIRED'
 WHEN operation NOT IN ('ADD_BLOCKER', 'RESOLVE_BLOCKER', 'ADD_WORK_ITEM', 'SET_OBJECTIVE', 'SET_CURRENT_PHASE', 'ADD_REQUIREMENT', 'RESOLVE_REQUIREMENT') THEN 'UNSUPPORTED_STATE_OPERATION'
 WHEN operation IN ('RESOLVE_BLOCKER', 'RESOLVE_REQUIREMENT') AND {_BLANK('record_id')} THEN 'LIFECYCLE_TARGET_REQUIRED' WHEN operation = 'SET_CURRENT_PHASE' AND phase = '' THEN 'PHASE_TARGET_REQUIRED' END"""


@query(f"""{views.with_views('projects')}, {_PROPOSALS}, rated AS (SELECT *, {_REASON} AS stopped FROM (SELECT o.*, p.status AS registered, lower(regexp_extract(text, '(?i)\\b(?:phase|faz|aşama)\\s*[- ]?(\\d+[A-Za-z]?)\\b', 1)) AS phase FROM proposals o LEFT JOIN projects p USING (project_id))),
 reached AS (FROM rated WHERE stopped IS NULL), {_replay_sql('reached')}
SELECT candidate_id, CASE WHEN stopped IN ('OPEN_LOOP_TO_MEMORY', 'MEMORY_TO_MEMORYSTORE') THEN 'SKIPPED' WHEN stopped IN ('PROJECT_UNRESOLVED', 'PROJECT_UNKNOWN', 'PROJECT_ARCHIVED') THEN 'SCOPE_ERROR'
  WHEN stopped IN ('UNTRUSTED_COMMITMENT', 'INVALID_PROVENANCE', 'LIFECYCLE_TARGET_REQUIRED', 'PHASE_TARGET_REQUIRED') THEN 'REVIEW_REQUIRED' WHEN accepted THEN 'SUCCESS' ELSE 'FAILED' END AS status,
 CASE WHEN stopped IS NOT NULL THEN stopped WHEN accepted THEN 'STATE_MUTATION_COMMITTED' WHEN operation LIKE 'ADD%' THEN 'STATE_MUTATION_FAILED' ELSE 'INVALID_TRANSITION' END AS reason,
 CASE WHEN accepted AND operation = 'SET_CURRENT_PHASE' THEN 'phase-' || phase END AS phase_id, revision - CASE WHEN accepted THEN 1 ELSE 0 END AS revision_before, CASE WHEN accepted THEN revision END AS revision_after
FROM rated LEFT JOIN replay USING (project_id, ordinal)""")
def state_boundary(spark, sf_dir):
    return state.applied_batch(_proposals(spark, sf_dir), views.projects(spark, sf_dir))
