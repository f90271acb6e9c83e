"""The registered queries of `memlake.operators.lifecycle`, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import graph, lifecycle
from memlake.operators.records import with_fingerprint
from memlake.sources import views
from memlake.sources.views import AS_OF, table

from .queries import _EDGES, FINGERPRINT, PROJECT, D, M, S, query
from .upkeep import CLAIM, DAY, derived, sql_view

#: Proposals about stored records, derived from the place in the store, alike in Spark and in SQL.
PROPOSED = {
    "candidate_id": "concat('cand_', CAST(store_ordinal AS STRING))",
    "operation": "CASE store_ordinal % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'SUPERSEDE_EXISTING' WHEN 2 THEN 'RESOLVE_EXISTING' WHEN 3 THEN 'CONFIRM_EXISTING' ELSE 'NEW' END",
    "target_id": "concat('mem_', lpad(CAST(CASE WHEN store_ordinal % 7 = 0 THEN store_ordinal + 1 WHEN store_ordinal % 11 = 0 THEN 90000000 ELSE store_ordinal END AS STRING), 8, '0'))",
    "successor_id": "CASE WHEN store_ordinal % 13 = 0 THEN memory_id ELSE concat('new_', CAST(store_ordinal AS STRING)) END",
    "confirms": "store_ordinal % 10 = 4",
    "said": "CASE WHEN store_ordinal % 2 = 0 THEN concat(content, ' anew') ELSE content END",
}
_STORE = f"{M}, {sql_view('claims', CLAIM, 'memories')}, store AS (SELECT *, {FINGERPRINT} AS fingerprint FROM claims)"
_DECISIONS = f"""{_STORE}, {sql_view('raw', PROPOSED, 'claims')}, proposed AS (SELECT * EXCLUDE (content), {FINGERPRINT.replace('content', 'said')} AS fingerprint FROM raw),
 equals AS (SELECT scope, project_id, fingerprint, min(store_ordinal) AS e FROM store GROUP BY ALL),
 rated AS (SELECT p.*, t.memory_id AS t_id, t.scope AS t_scope, t.project_id AS t_project, t.status AS t_status, q.e, h.first AS h,
   CASE WHEN h.first = t.store_ordinal THEN h.second ELSE h.first END AS o, EXISTS (FROM store z WHERE z.memory_id = p.successor_id) AS taken
  FROM proposed p LEFT JOIN store t ON t.memory_id = p.target_id LEFT JOIN equals q ON q.scope = p.scope AND q.project_id = p.project_id AND q.fingerprint = p.fingerprint
  LEFT JOIN (SELECT scope, project_id, claim_key, list_sort(list(store_ordinal))[1] AS first, list_sort(list(store_ordinal))[2] AS second FROM store WHERE claim_key <> '' AND status = 'active' GROUP BY ALL) h
   ON h.scope = p.scope AND h.project_id = p.project_id AND h.claim_key = p.claim_key),
 reasoned AS (SELECT *, CASE WHEN operation = 'NEW' THEN (CASE WHEN e IS NOT NULL AND (h IS NULL OR e <= h) THEN 'EXACT_SCOPED_FINGERPRINT' WHEN h IS NOT NULL THEN 'ACTIVE_CLAIM_KEY_CONFLICT' ELSE 'NO_SCOPED_MATCH' END)
   WHEN t_id IS NULL THEN 'LIFECYCLE_TARGET_UNKNOWN' WHEN t_scope <> scope OR t_project <> project_id THEN 'SCOPE_MISMATCH' WHEN operation = 'CONFIRM_EXISTING' THEN 'EXPLICIT_CONFIRMATION' WHEN t_status <> 'active' THEN 'TARGET_NOT_ACTIVE'
   WHEN operation = 'RESOLVE_EXISTING' THEN 'EXPLICIT_LIFECYCLE_MUTATION' WHEN successor_id = target_id OR taken THEN 'SUPERSESSION_CYCLE_OR_DUPLICATE' WHEN o IS NOT NULL THEN 'ACTIVE_CLAIM_KEY_CONFLICT' ELSE 'EXPLICIT_SUPERSESSION' END AS reason FROM rated),
 decided AS (SELECT candidate_id, CASE WHEN reason = 'EXACT_SCOPED_FINGERPRINT' AND confirms THEN 'CONFIRM_EXISTING' WHEN reason = 'EXACT_SCOPED_FINGERPRINT' THEN 'DUPLICATE' WHEN reason = 'ACTIVE_CLAIM_KEY_CONFLICT' THEN 'CONFLICT'
   WHEN reason LIKE 'EXPLICIT%' OR reason = 'NO_SCOPED_MATCH' THEN operation ELSE 'REVIEW_REQUIRED' END AS action, reason,
   CASE WHEN reason IN ('NO_SCOPED_MATCH', 'LIFECYCLE_TARGET_UNKNOWN') THEN '' WHEN reason = 'EXACT_SCOPED_FINGERPRINT' THEN 'mem_' || lpad(CAST(e AS VARCHAR), 8, '0')
    WHEN reason = 'ACTIVE_CLAIM_KEY_CONFLICT' THEN 'mem_' || lpad(CAST(CASE WHEN operation = 'NEW' THEN h ELSE o END AS VARCHAR), 8, '0') ELSE target_id END AS target,
   CASE WHEN reason = 'EXPLICIT_SUPERSESSION' THEN successor_id ELSE '' END AS successor FROM reasoned)"""


def _store(spark, sf_dir):
    return with_fingerprint(derived(views.memories(spark, sf_dir), CLAIM))


def _proposed(spark, sf_dir):
    raw = derived(derived(views.memories(spark, sf_dir), CLAIM), PROPOSED)
    return with_fingerprint(raw.withColumn("content", F.col("said")))


@query(f"{_DECISIONS} SELECT * FROM decided")
def lifecycle_decisions(spark, sf_dir):
    return lifecycle.lifecycle_decisions(_proposed(spark, sf_dir), _store(spark, sf_dir))


@query(f"""{_DECISIONS}, acts AS (SELECT d.*, p.store_ordinal AS ordinal, p.scope, p.project_id, p.fingerprint, p.successor_id FROM decided d JOIN proposed p USING (candidate_id)),
 last AS (SELECT target, CASE arg_max(action, ordinal) WHEN 'SUPERSEDE_EXISTING' THEN 'superseded' ELSE 'resolved' END AS status, arg_max(successor, ordinal) FILTER (WHERE action = 'SUPERSEDE_EXISTING') AS by FROM acts WHERE action IN ('SUPERSEDE_EXISTING', 'RESOLVE_EXISTING') GROUP BY target)
SELECT memory_id, coalesce(l.status, m.status) AS status, coalesce(l.by, m.superseded_by) AS superseded_by FROM memories m LEFT JOIN last l ON l.target = m.memory_id
UNION ALL SELECT successor, 'active', '' FROM acts WHERE action = 'SUPERSEDE_EXISTING'
UNION ALL (SELECT successor_id, 'active', '' FROM acts WHERE action = 'NEW' QUALIFY row_number() OVER (PARTITION BY scope, project_id, fingerprint ORDER BY ordinal) = 1)""")
def truth_commit(spark, sf_dir):
    proposed, store = _proposed(spark, sf_dir), _store(spark, sf_dir)
    own = proposed.select("candidate_id", F.col("store_ordinal").alias("ordinal"), "scope", "project_id", "fingerprint", "successor_id")
    decided = lifecycle.lifecycle_decisions(proposed, store).join(own, "candidate_id")
    return lifecycle.committed(store, decided.withColumn("successor", F.when(F.col("action") == "NEW", F.col("successor_id")).otherwise(F.col("successor"))))


_STATES = list(lifecycle.WORK_ITEM_MOVES)
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, following in lifecycle.WORK_ITEM_MOVES.items() for b in following)


@query(f"""SELECT event_id, ({views._sql_list(tuple(_STATES))}[CAST(event_id % 5 AS INTEGER) + 1], {views._sql_list(tuple(_STATES))}[CAST(user_id % 5 AS INTEGER) + 1]) IN ({_PAIRS}) AS allowed FROM events""")
def state_transitions(spark, sf_dir):
    state = lambda x: views.pick(tuple(_STATES), F.col(x) % 5)
    return table(spark, sf_dir, "events").select("event_id", lifecycle.may_move(lifecycle.WORK_ITEM_MOVES, state("event_id"), state("user_id")).alias("allowed"))


_REVISED = {"project_id": "user_id % 9", "old_revision": "event_id // 9 % 400 - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END", "new_revision": "event_id // 9 % 400 + CASE WHEN event_id % 23 = 0 THEN 2 ELSE 1 END"}


@query(f"""WITH e AS (SELECT event_id, {', '.join(f'{x} AS {c}' for c, x in _REVISED.items())} FROM events) SELECT event_id, problem FROM (SELECT event_id, CASE WHEN new_revision <> old_revision + 1 THEN 'step' WHEN event_id <> min(event_id) OVER (PARTITION BY project_id, old_revision) THEN 'fork'
 WHEN old_revision <> 0 AND NOT EXISTS (FROM e y WHERE y.project_id = e.project_id AND y.new_revision = e.old_revision AND y.new_revision = y.old_revision + 1) THEN 'gap' END AS problem FROM e) WHERE problem IS NOT NULL""")
def state_revision_breaks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return lifecycle.broken_revisions(events.select("event_id", *[F.expr(x.replace("event_id // 9", "(event_id div 9)")).alias(c) for c, x in _REVISED.items()]))


@query("""WITH u AS (SELECT event_id, user_id AS entity, event_type AS type, 'n' || CAST(event_id % 31 AS VARCHAR) AS name, 'k' || CAST(event_id % 3 AS VARCHAR) AS k, CAST(event_id % 100 AS VARCHAR) AS v FROM events),
 p AS (SELECT entity, k, arg_max(v, event_id) AS v FROM u GROUP BY ALL), q AS (SELECT entity, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM p GROUP BY entity)
SELECT entity, arg_max(type, event_id) AS type, arg_max(name, event_id) AS name, min(event_id) AS created, any_value(q.properties) AS properties FROM u JOIN q USING (entity) GROUP BY entity""")
def graph_upserts(spark, sf_dir):
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    n = F.col("event_id")
    upserts = table(spark, sf_dir, "events").select(n.alias("ordinal"), F.col("user_id").alias("entity"), F.col("event_type").alias("type"), text("n", n % 31).alias("name"), F.create_map(text("k", n % 3), text("", n % 100)).alias("properties"))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return lifecycle.upserted_entities(upserts).withColumn("properties", flat)


@query(f"{S}, {_EDGES} SELECT node, node_type FROM nodes LEFT JOIN own ON memory_id = node WHERE contains(node, 'e') AND CASE node_type WHEN 'PROJECT' THEN node = 'project_{PROJECT}' WHEN 'MEMORY' THEN scope = 'global' OR project_id = '{PROJECT}' ELSE true END")
def graph_find_entities(spark, sf_dir):
    s = views.statements(spark, sf_dir)
    own = graph.nodes(s).where(F.col("node").contains("e")).join(s.select(F.col("memory_id").alias("node"), "scope", F.col("project_id").alias("of")), "node", "left")
    owner = F.when(F.col("node_type") == "PROJECT", F.expr("substring(node, 9)")).otherwise(F.col("of"))
    return own.where(lifecycle.visible(F.col("node_type"), F.col("scope"), owner, PROJECT, "default")).select("node", "node_type")


_WAYS = "both_ways AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges)"


@query(f"{S}, {_EDGES}, {_WAYS}, near AS (SELECT 'phase_7' AS node UNION SELECT v FROM both_ways WHERE u = 'phase_7' UNION SELECT b.v FROM both_ways a JOIN both_ways b ON b.u = a.v WHERE a.u = 'phase_7') SELECT src, dst, rel_type FROM edges SEMI JOIN near n ON n.node = src SEMI JOIN near m ON m.node = dst")
def graph_induced_edges(spark, sf_dir):
    edges = graph.edges(views.statements(spark, sf_dir))
    return lifecycle.induced_edges(edges, graph.distances(edges, "phase_7", 2)).select("src", "dst", "rel_type")


_FROM, _TO = AS_OF - 17 * DAY, AS_OF - 10 * DAY


@query(f"""{D.replace('WITH RECURSIVE ', M + ', ')}, items AS (SELECT 'Shop' AS label, 1 AS r, 'session' AS kind, CAST(session AS VARCHAR) AS id, min(at_s) AS first_s, max(at_s) AS last_s FROM deliveries GROUP BY session
 UNION ALL SELECT coalesce(project_id, ''), 2, 'memory', memory_id, at_s, at_s FROM memories WHERE status = 'active')
SELECT label, kind, id, last_s FROM items WHERE first_s < {_TO} AND last_s >= {_FROM} ORDER BY label, r, last_s DESC, id LIMIT 50""")
def recap(spark, sf_dir):
    sessions = views.deliveries(spark, sf_dir).groupBy("session").agg(F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s")).select(F.lit("Shop").alias("label"), F.lit("session").alias("kind"), F.col("session").cast("string").alias("id"), "first_s", "last_s")
    memories = views.memories(spark, sf_dir).where("status = 'active'").select(F.coalesce("project_id", F.lit("")).alias("label"), F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.col("at_s").alias("first_s"), F.col("at_s").alias("last_s"))
    return lifecycle.recap(sessions.union(memories), _FROM, _TO).select("label", "kind", "id", "last_s")
