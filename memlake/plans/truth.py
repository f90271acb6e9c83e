"""The registered queries of `memlake.operators.truth`, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import truth
from memlake.operators.records import with_fingerprint
from memlake.sources import views

from .lifecycle import PROPOSED
from .queries import FINGERPRINT, query, reason_sql
from .upkeep import CLAIM, derived, sql_view

#: Batches of seven proposals, alike in Spark and in SQL; some ask without a target or without saying who they are.
BATCH = PROPOSED | {
    "operation_id": "concat('op_', CAST(CAST(floor(store_ordinal / 7) AS BIGINT) AS STRING))",
    "position": "store_ordinal % 7",
    "ordinal": "store_ordinal",
    "target_id": f"CASE WHEN store_ordinal % 19 = 0 THEN '' ELSE {PROPOSED['target_id']} END",
    "commitment": "CASE WHEN store_ordinal % 23 = 0 THEN 'PROPOSED' ELSE 'COMMITTED' END",
    "source": "CASE WHEN store_ordinal % 2 = 0 THEN 'user' ELSE 'worker' END",
    "stated": "CAST(floor(store_ordinal / 7) AS BIGINT) % 3 > 0",
    "approved": "is_approved OR store_ordinal % 4 > 0",
}
_ID = "'mem_' || lpad(CAST(%s AS VARCHAR), 8, '0')"
_BATCH = f"""{views.with_views('memories', 'projects')}, {sql_view('claims', CLAIM, 'memories')}, store AS (SELECT *, {FINGERPRINT} AS fingerprint FROM claims), {sql_view('raw', BATCH, 'claims')},
 proposed AS (SELECT * EXCLUDE (content), said AS content, {FINGERPRINT.replace('content', 'said')} AS fingerprint FROM raw),
 safe AS (SELECT o.*, {reason_sql('content')} AS unsafe, p.status AS registered, p.proactive_capture FROM proposed o LEFT JOIN projects p USING (project_id)),
 stopped AS (SELECT *, CASE unsafe WHEN 'potential_secret' THEN 'SECRET_CONTENT' WHEN 'payload_too_large' THEN 'CAPTURE_TOO_LARGE' WHEN 'too_many_lines' THEN 'CAPTURE_TOO_MANY_LINES' WHEN 'transcript_like' THEN 'CAPTURE_TRANSCRIPT_LIKE' ELSE
   CASE WHEN scope = 'global' AND project_id <> '' THEN 'GLOBAL_PROJECT_METADATA' WHEN scope = 'project' AND project_id = '' THEN 'SCOPE_UNRESOLVED' WHEN scope = 'project' AND registered IS NULL THEN 'PROJECT_UNREGISTERED'
    WHEN scope = 'project' AND registered = 'archived' THEN 'PROJECT_ARCHIVED' WHEN scope = 'project' AND NOT proactive_capture THEN 'PROJECT_CAPTURE_DISABLED' END END AS rejected,
   CASE WHEN stated AND NOT approved THEN 'UNAPPROVED_CANDIDATE' WHEN commitment <> 'COMMITTED' THEN 'UNCOMMITTED_CANDIDATE' WHEN NOT approved THEN 'UNAPPROVED_CANDIDATE' WHEN operation <> 'NEW' AND target_id = '' THEN 'LIFECYCLE_TARGET_UNKNOWN' END AS review FROM safe),
 equals AS (SELECT scope, project_id, fingerprint, min(store_ordinal) AS e FROM store GROUP BY ALL),
 holders AS (SELECT scope, project_id, claim_key, list_sort(list(store_ordinal)) AS held FROM store WHERE claim_key <> '' AND status = 'active' GROUP BY ALL),
 met AS (SELECT p.*, t.memory_id AS t_id, t.scope AS t_scope, t.project_id AS t_project, t.status AS t_status, q.e, h.held[1] AS h, CASE WHEN h.held[1] = t.store_ordinal THEN h.held[2] ELSE h.held[1] END AS o, EXISTS (FROM store z WHERE z.memory_id = p.successor_id) AS taken
  FROM stopped p LEFT JOIN store t ON t.memory_id = p.target_id LEFT JOIN equals q ON q.scope = p.scope AND q.project_id = p.project_id AND q.fingerprint = p.fingerprint LEFT JOIN holders h ON h.scope = p.scope AND h.project_id = p.project_id AND h.claim_key = p.claim_key),
 reasoned AS (SELECT *, CASE WHEN rejected IS NOT NULL THEN rejected WHEN review IS NOT NULL THEN review WHEN operation = 'NEW' THEN (CASE WHEN e IS NOT NULL AND (h IS NULL OR e <= h) THEN 'EXACT_SCOPED_FINGERPRINT' WHEN h IS NOT NULL THEN 'ACTIVE_CLAIM_KEY_CONFLICT' ELSE 'NO_SCOPED_MATCH' END)
   WHEN t_id IS NULL THEN 'LIFECYCLE_TARGET_UNKNOWN' WHEN t_scope <> scope OR t_project <> project_id THEN 'SCOPE_MISMATCH' WHEN operation = 'CONFIRM_EXISTING' THEN 'EXPLICIT_CONFIRMATION' WHEN t_status <> 'active' THEN 'TARGET_NOT_ACTIVE'
   WHEN operation = 'RESOLVE_EXISTING' THEN 'EXPLICIT_LIFECYCLE_MUTATION' WHEN successor_id = target_id OR taken THEN 'SUPERSESSION_CYCLE_OR_DUPLICATE' WHEN o IS NOT NULL THEN 'ACTIVE_CLAIM_KEY_CONFLICT' ELSE 'EXPLICIT_SUPERSESSION' END AS why FROM met),
 acted AS (SELECT *, CASE WHEN rejected IS NOT NULL THEN 'REJECT' WHEN review IS NOT NULL THEN 'REVIEW_REQUIRED' WHEN why = 'EXACT_SCOPED_FINGERPRINT' AND confirms THEN 'CONFIRM_EXISTING' WHEN why = 'EXACT_SCOPED_FINGERPRINT' THEN 'DUPLICATE' WHEN why = 'ACTIVE_CLAIM_KEY_CONFLICT' THEN 'CONFLICT'
   WHEN why LIKE 'EXPLICIT%' OR why = 'NO_SCOPED_MATCH' THEN operation ELSE 'REVIEW_REQUIRED' END AS act FROM reasoned),
 firsts AS (SELECT *, first_value(ordinal) OVER w AS first_ordinal, first_value(successor_id) OVER w AS first_id FROM acted WHERE act = 'NEW' WINDOW w AS (PARTITION BY scope, project_id, fingerprint ORDER BY ordinal)),
 decisions AS (SELECT a.operation_id, a.position, a.candidate_id, CASE WHEN f.first_ordinal < a.ordinal THEN 'DUPLICATE' ELSE a.act END AS action, CASE WHEN f.first_ordinal < a.ordinal THEN 'EXACT_SCOPED_FINGERPRINT' ELSE a.why END AS reason,
   CASE WHEN f.first_ordinal < a.ordinal THEN f.first_id WHEN a.rejected IS NOT NULL OR a.review IS NOT NULL OR a.why IN ('NO_SCOPED_MATCH', 'LIFECYCLE_TARGET_UNKNOWN') THEN '' WHEN a.why = 'EXACT_SCOPED_FINGERPRINT' THEN {_ID % 'a.e'} WHEN a.why = 'ACTIVE_CLAIM_KEY_CONFLICT' THEN {_ID % "CASE WHEN a.operation = 'NEW' THEN a.h ELSE a.o END"} ELSE a.target_id END AS target,
   CASE WHEN a.act = 'NEW' AND f.first_ordinal = a.ordinal THEN a.successor_id WHEN a.why = 'EXPLICIT_SUPERSESSION' THEN a.successor_id ELSE '' END AS successor FROM acted a LEFT JOIN firsts f ON f.ordinal = a.ordinal),
 settled AS (SELECT operation_id, count(*) FILTER (action IN ('REJECT', 'REVIEW_REQUIRED', 'CONFLICT')) = 0 AS receipted FROM decisions GROUP BY 1)"""


def _store(spark, sf_dir) -> DataFrame:
    return with_fingerprint(derived(views.memories(spark, sf_dir), CLAIM))


def _batch(spark, sf_dir) -> DataFrame:
    return with_fingerprint(derived(derived(views.memories(spark, sf_dir), CLAIM), BATCH).withColumn("content", F.col("said")))


def _nothing(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "operation_id string, request_hash string, provenance_hash string"), spark.createDataFrame([], "operation_id string, position long, candidate_id string, action string, reason string, target string, successor string")


def _processed(spark, sf_dir) -> truth.Processed:
    return truth.process(_batch(spark, sf_dir), _store(spark, sf_dir), views.projects(spark, sf_dir), *_nothing(spark))


@query(f"{_BATCH} SELECT * FROM decisions")
def truth_process(spark, sf_dir):
    return _processed(spark, sf_dir).decisions


@query(f"{_BATCH} SELECT operation_id, 'DECIDE' AS state, receipted FROM settled")
def truth_receipts(spark, sf_dir):
    done = _processed(spark, sf_dir)
    kept = done.receipts.select("operation_id", F.lit(True).alias("receipted"))
    return done.operations.join(kept, "operation_id", "left").select("operation_id", "state", F.coalesce("receipted", F.lit(False)).alias("receipted"))


@query(f"""{_BATCH} SELECT s.operation_id, CASE WHEN NOT s.receipted THEN 'DECIDE' WHEN CAST(substr(s.operation_id, 4) AS BIGINT) % 5 = 0 THEN 'MISMATCH' ELSE 'REPLAY' END AS state,
 CASE WHEN NOT s.receipted OR CAST(substr(s.operation_id, 4) AS BIGINT) % 5 = 0 THEN 0 ELSE (SELECT count(*) FROM decisions d WHERE d.operation_id = s.operation_id) END AS replayed FROM settled s""")
def truth_replay(spark, sf_dir):
    """The batch again, after it: every fifth operation has changed, the others give what is stored."""
    done = _processed(spark, sf_dir)
    changed = F.expr("CAST(substring(operation_id, 4) AS BIGINT) % 5 = 0")
    again = _batch(spark, sf_dir).withColumn("confidence", F.when(changed, F.col("confidence") + 1).otherwise(F.col("confidence")))
    states = truth.operation_states(again, done.receipts)
    stored = done.receipted.groupBy("operation_id").agg(F.count("*").alias("n"))
    return states.join(stored, "operation_id", "left").select("operation_id", "state", F.when(F.col("state") == "REPLAY", F.col("n")).otherwise(0).alias("replayed"))


@query(f"""{_BATCH}, effects AS (SELECT d.*, p.ordinal FROM decisions d JOIN proposed p USING (candidate_id)),
 last AS (SELECT target, CASE arg_max(action, ordinal) WHEN 'SUPERSEDE_EXISTING' THEN 'superseded' ELSE 'resolved' END AS status, arg_max(successor, ordinal) FILTER (WHERE action = 'SUPERSEDE_EXISTING') AS by FROM effects WHERE action IN ('SUPERSEDE_EXISTING', 'RESOLVE_EXISTING') GROUP BY target)
SELECT memory_id, store_ordinal, coalesce(l.status, s.status) AS status, coalesce(l.by, s.superseded_by) AS superseded_by, scope, claim_key FROM store s LEFT JOIN last l ON l.target = s.memory_id
UNION ALL SELECT e.successor, (SELECT max(store_ordinal) FROM store) + 1 + e.ordinal, 'active', '', p.scope, p.claim_key FROM effects e JOIN proposed p USING (candidate_id) WHERE action IN ('NEW', 'SUPERSEDE_EXISTING')""")
def truth_store(spark, sf_dir):
    return _processed(spark, sf_dir).records.select("memory_id", "store_ordinal", "status", "superseded_by", "scope", "claim_key")
