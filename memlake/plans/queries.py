"""The registered queries of the engine's own operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scoring, text
from memlake.operators import capture, graph, records, search, selection, similarity
from memlake.sources import views
from memlake.sources.views import AS_OF, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ASKED, PROJECT = "we decided to use postgresql in phase 3.", "p_en"
STATE_TOKENS = ("postgresql", "release", "phase", "build", "cache")
QUESTIONS = [("database", [["postgresql", "postgres"], ["phase 3"]]), ("cache", [["redis"]]), ("tests", [["pytest"], ["enough"]]), ("orchestration", [["kubernetes"]]), ("release", [["must be tested"], ["release", "deploy"]])]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- SQL of shared expressions ------------------------------------------------------------------------------------------------------
M, S, E, L, D = with_views("memories"), with_views("statements"), with_views("evidence"), with_views("ledger"), with_views("deliveries")
WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(%s), '\s+'), lambda w: w <> ''))"
TOKENS = r"list_sort(list_distinct(list_filter(regexp_extract_all(lower(%s), '[a-z0-9'']+'), lambda w: len(w) > 1 AND NOT list_contains(" + views._sql_list(text.STOPWORDS) + ", w))))"
NORMAL = r"trim(regexp_replace(lower(%s), '\s+', ' ', 'g'))"
FINGERPRINT = f"substr(sha256(scope || ':' || project_id || chr(10) || type || chr(10) || {NORMAL % 'content'}), 1, 16)"
DAYS = f"(({AS_OF} - at_s) // 86400)"
FRESH = f"(CASE WHEN {DAYS} = 0 THEN 1e0 WHEN {DAYS} = 1 THEN 9e-1 WHEN {DAYS} <= 7 THEN greatest(5e-1, 1e0 - {DAYS} * 7e-2) ELSE 3e-1 END)"
PRIORITY = "(CASE type WHEN 'decision' THEN 1e0 WHEN 'lesson' THEN 8e-1 WHEN 'open_loop' THEN 9e-1 WHEN 'observation' THEN 6e-1 ELSE 5e-1 END)"
ACTIVE, SCOPED = "coalesce(status, 'active') = 'active'", f"(scope = 'global' OR (scope = 'project' AND project_id = '{PROJECT}'))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


def reason_sql(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    secret = " OR ".join(rlike(x, p) for p in text.SECRETS)
    return f"""CASE WHEN {secret} THEN 'potential_secret' WHEN length({x}) > {text.MAX_CHARS} THEN 'payload_too_large'
 WHEN len({lines}) - (CASE WHEN suffix({x}, chr(10)) OR {x} = '' THEN 1 ELSE 0 END) > {text.MAX_LINES} THEN 'too_many_lines'
 WHEN len(list_filter({lines}, lambda y: regexp_matches(y, {quoted(text.ROLE_LINE)}))) >= {text.ROLE_LINES} AND length({x}) >= {text.ROLE_CHARS} THEN 'transcript_like' ELSE '' END"""


def commitment_sql(x: str, role: str) -> str:
    m = lambda p: rlike(x, p)
    return f"""CASE WHEN {m(text.QUOTE)} OR {m(text.QUOTE_WORD)} THEN 'QUOTED' WHEN contains({x}, '?') OR {m(text.QUESTION)} THEN 'QUESTION' WHEN {m(text.HYPOTHETICAL)} THEN 'HYPOTHETICAL'
 WHEN {role} IN ('assistant', 'tool', 'system') THEN 'PROPOSED' WHEN {m(text.CORRECTION)} AND NOT {m(text.DECISION)} THEN 'NEGATED' WHEN {m(text.DECISION)} OR {m(text.APPROVED_ACTION)} THEN 'COMMITTED'
 WHEN {m(text.CURRENT)} OR {m(text.RESOLVED)} OR {m(text.REQUIREMENT)} THEN 'OBSERVED' ELSE 'UNCERTAIN' END"""


# --- Scans, scope, retrieval --------------------------------------------------------------------------------------------------------
@query(f"{M} SELECT memory_id, type FROM memories WHERE {ACTIVE}")
def scan_active(spark, sf_dir):
    return views.memories(spark, sf_dir).where(search.active()).select("memory_id", "type")


@query(f"{M} SELECT memory_id, scope, project_id FROM memories WHERE {SCOPED}")
def scope_filter_default(spark, sf_dir):
    return views.memories(spark, sf_dir).where(search.in_scope(PROJECT)).select("memory_id", "scope", "project_id")


@query(f"{M} SELECT memory_id, project_id FROM memories WHERE scope = 'project' AND project_id = '{PROJECT}'")
def scope_filter_project(spark, sf_dir):
    return views.memories(spark, sf_dir).where(search.in_scope(PROJECT, "project")).select("memory_id", "project_id")


_ASKED = "[" + ", ".join(quoted(w) for w in dict.fromkeys(ASKED.split())) + "]"
_LEX = f"""lex AS (SELECT memory_id, store_ordinal, type, substr(content, 1, 100) AS content, sim AS similarity, sim * 4e-1 + quality_score * 3e-1 + {PRIORITY} * 2e-1 + {FRESH} * 1e-1 AS score
 FROM (SELECT *, {jaccard(_ASKED, WORDS % 'content')} AS sim FROM statements WHERE {ACTIVE} AND {SCOPED}) WHERE sim >= 0.05 ORDER BY score DESC, store_ordinal LIMIT 10)"""
_SEM = """sem AS (SELECT memory_id, store_ordinal, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS similarity
 FROM statements JOIN embeddings ON store_ordinal = vec_id ORDER BY similarity DESC, store_ordinal LIMIT 10)"""
_HYB = """hyb AS (SELECT *, (CASE WHEN (SELECT count(*) FROM sem) > 0 THEN lexical_score * 4e-1 + semantic_score * 6e-1 ELSE lexical_score END) * (1e0 + novelty * 1e-1) AS combined_score FROM (
 SELECT memory_id, s.store_ordinal, s.content, s.quality_score, s.novelty, s.at_s, CASE WHEN l.memory_id IS NULL THEN 'semantic' WHEN m.memory_id IS NULL THEN 'lexical' ELSE 'both' END AS search_type,
  coalesce(l.score, 0e0) AS lexical_score, coalesce(m.similarity, 0e0) AS semantic_score FROM lex l FULL JOIN sem m USING (memory_id) JOIN statements s USING (memory_id))
 ORDER BY combined_score DESC, (CASE WHEN search_type = 'semantic' THEN 1 ELSE 0 END), store_ordinal LIMIT 10)"""


def _lexical(spark, sf_dir):
    return search.lexical_search(views.statements(spark, sf_dir), ASKED, AS_OF, search.SHORTLIST, PROJECT)


def _semantic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").first()
    return search.semantic_search(views.statements(spark, sf_dir), vectors, list(asked[0]) if asked else [0.0])


def _hybrid(spark, sf_dir):
    return search.hybrid(_lexical(spark, sf_dir), _semantic(spark, sf_dir), views.statements(spark, sf_dir))


@query(f"{S}, {_LEX} SELECT memory_id, type, content, round(similarity, 6) AS similarity, round(score, 6) AS score FROM lex")
def lexical_search(spark, sf_dir):
    return rounded(_lexical(spark, sf_dir).drop("store_ordinal"), "similarity", "score")


@query(f"{M} SELECT memory_id, round(quality_score * 6e-1 + {FRESH} * 4e-1, 6) AS score FROM memories WHERE type = 'decision' ORDER BY quality_score * 6e-1 + {FRESH} * 4e-1 DESC, store_ordinal LIMIT 10")
def get_by_type(spark, sf_dir):
    return rounded(search.by_type(views.memories(spark, sf_dir), "decision", AS_OF).drop("store_ordinal"), "score")


@query(f"{S}, {_SEM} SELECT memory_id, round(similarity, 6) AS similarity FROM sem")
def semantic_search(spark, sf_dir):
    return rounded(_semantic(spark, sf_dir).drop("store_ordinal"), "similarity")


@query("""SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
 SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def batch_semantic_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(search.batch_semantic_search(vectors, vectors.where("vec_id % 100 = 0")), "similarity")


@query(f"{S}, {_LEX}, {_SEM}, {_HYB} SELECT memory_id, search_type, round(lexical_score, 6) AS lexical_score, round(semantic_score, 6) AS semantic_score, round(combined_score, 6) AS combined_score FROM hyb")
def hybrid_search(spark, sf_dir):
    return rounded(_hybrid(spark, sf_dir).select("memory_id", "search_type", "lexical_score", "semantic_score", "combined_score"), "lexical_score", "semantic_score", "combined_score")


_WORDS_IN = " AND ".join(f"contains(lower(content), {quoted(w)})" for w in ASKED.split())
_RANK = f"""ranked AS (SELECT *, f_rel * 4e-1 + quality_score * 2e-1 + f_recency * 15e-2 + novelty * 15e-2 + f_match * 1e-1 AS ml_score FROM (SELECT *, least(1e0, greatest(0e0, combined_score)) AS f_rel,
 greatest(1e-1, least(1e0, exp(-CAST({DAYS} AS DOUBLE) / 30))) AS f_recency, CASE WHEN starts_with(lower(content), {quoted(ASKED)}) THEN 1e0 WHEN {_WORDS_IN} THEN 9e-1 WHEN contains(lower(content), {quoted(ASKED)}) THEN 7e-1 ELSE 5e-1 END AS f_match FROM hyb))"""


@query(f"{S}, {_LEX}, {_SEM}, {_HYB}, {_RANK} SELECT memory_id, round(f_recency, 6) AS f_recency, f_match AS f_match_type, round(ml_score, 6) AS ml_score FROM ranked")
def heuristic_rank(spark, sf_dir):
    return rounded(search.heuristic_rank(_hybrid(spark, sf_dir), ASKED, AS_OF).select("memory_id", "f_recency", "f_match_type", "ml_score"), "f_recency", "ml_score")


@query(f"{S}, {_LEX}, {_SEM}, {_HYB}, {_RANK} SELECT count(*) AS n, round(avg(ml_score), 6) AS mean_score, round(max(ml_score), 6) AS max_score, round(min(ml_score), 6) AS min_score, round(avg(f_recency), 6) AS mean_recency FROM ranked")
def ranking_analysis(spark, sf_dir):
    r = search.heuristic_rank(_hybrid(spark, sf_dir), ASKED, AS_OF)
    return rounded(r.agg(F.count("*").alias("n"), F.avg("ml_score").alias("mean_score"), F.max("ml_score").alias("max_score"), F.min("ml_score").alias("min_score"), F.avg("f_recency").alias("mean_recency")), "mean_score", "max_score", "min_score", "mean_recency")


@query(f"""{S}, {_LEX}, {_SEM}, {_HYB} SELECT count(*) AS total, count(*) FILTER (search_type = 'both') AS found_in_both, count(*) FILTER (search_type = 'lexical') AS lexical_only, round(avg(combined_score), 6) AS quality,
 round(avg(lexical_score) FILTER (lexical_score > 0), 6) AS avg_lexical FROM hyb""")
def search_quality(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("search_type") == k)
    found = _hybrid(spark, sf_dir).agg(F.count("*").alias("total"), kind("both").alias("found_in_both"), kind("lexical").alias("lexical_only"), F.avg("combined_score").alias("quality"), F.avg(F.when(F.col("lexical_score") > 0, F.col("lexical_score"))).alias("avg_lexical"))
    return rounded(found, "quality", "avg_lexical")


# --- Fingerprints, duplicates, lifecycle --------------------------------------------------------------------------------------------
@query(f"{M} SELECT memory_id, {FINGERPRINT} AS fingerprint FROM memories")
def fingerprint(spark, sf_dir):
    return records.with_fingerprint(views.memories(spark, sf_dir)).select("memory_id", "fingerprint")


@query(f"{M} SELECT memory_id, survivor FROM (SELECT memory_id, first_value(memory_id) OVER (PARTITION BY {FINGERPRINT} ORDER BY at_s, memory_id) AS survivor FROM memories WHERE status <> 'superseded') WHERE memory_id <> survivor")
def dedupe_plan(spark, sf_dir):
    return records.dedupe_plan(views.memories(spark, sf_dir))


C = with_views("candidates")


@query(f"""{C} SELECT candidate_id, duplicates FROM (SELECT candidate_id, count(*) OVER w - 1 AS duplicates, row_number() OVER (PARTITION BY project_id, scope, type, content ORDER BY confidence DESC, created, candidate_id) AS r
 FROM candidates WINDOW w AS (PARTITION BY project_id, scope, type, content)) WHERE r = 1""")
def review_primary(spark, sf_dir):
    return records.review_primaries(views.candidates(spark, sf_dir))


@query(f"""{M}, chain AS (SELECT memory_id, 0 AS hops, memory_id AS last, superseded_by AS ahead FROM memories WHERE superseded_by <> '' UNION ALL
 SELECT c.memory_id, c.hops + 1, m.memory_id, m.superseded_by FROM chain c JOIN memories m ON c.ahead = m.memory_id WHERE c.hops < 2000),
 ends AS (SELECT memory_id, hops, last FROM chain c WHERE ahead = '' OR NOT EXISTS (FROM memories m WHERE m.memory_id = c.ahead))
SELECT m.memory_id, CAST(e.hops AS BIGINT) AS hops, e.last, e.memory_id IS NULL AS unfinished FROM memories m LEFT JOIN ends e USING (memory_id) WHERE m.superseded_by <> ''""")
def supersession_chain(spark, sf_dir):
    return records.supersession_chains(views.memories(spark, sf_dir))


# --- Anomalies ----------------------------------------------------------------------------------------------------------------------
_GAP = "abs(quality_score - confidence)"
_PAIRS = f"""sets AS (SELECT type, t, min(store_ordinal) AS id FROM (SELECT type, store_ordinal, {TOKENS % 'content'} AS t FROM memories WHERE status = 'active') WHERE len(t) > 0 GROUP BY type, t),
 pairs AS (SELECT x.id AS a, y.id AS b, {jaccard('x.t', 'y.t')} AS similarity FROM sets x JOIN sets y ON x.type = y.type AND x.id < y.id WHERE least(len(x.t), len(y.t)) >= greatest(len(x.t), len(y.t)) * 6e-1 - 1e-9 AND {jaccard('x.t', 'y.t')} >= 6e-1
 UNION ALL SELECT s.id, m.store_ordinal, 1e0 FROM (SELECT type, store_ordinal, {TOKENS % 'content'} AS t FROM memories WHERE status = 'active') m JOIN sets s ON s.type = m.type AND s.t = m.t WHERE s.id <> m.store_ordinal)"""
_DETECTED = f"""found AS (
 SELECT 'stale_open_loop' AS detector, 'warning' AS severity, memory_id, CAST({AS_OF} - at_s AS DOUBLE) / 86400 AS figure FROM memories WHERE type = 'open_loop' AND status = 'active' AND {AS_OF} - at_s >= 259200
 UNION ALL SELECT 'low_confidence_outlier', 'info', memory_id, confidence FROM memories WHERE is_approved AND coalesce(confidence, 1) < 3e-1
 UNION ALL SELECT 'quality_confidence_gap', 'info', memory_id, {_GAP} FROM memories WHERE round({_GAP}, 9) >= 0.5
 UNION ALL SELECT 'burst_ingestion', 'warning', min(memory_id), count(*) FROM memories GROUP BY at_s HAVING count(*) >= 15
 UNION ALL SELECT 'broken_supersession', 'critical', memory_id, 1 FROM memories WHERE superseded_by <> '' AND superseded_by NOT IN (SELECT memory_id FROM memories)
 UNION ALL SELECT 'trivial_content', 'info', memory_id, length(trim(content)) FROM memories WHERE length(trim(content)) < 10)"""


def _detector(name: str):
    def run(spark, sf_dir):
        found = records.anomalies(views.memories(spark, sf_dir), AS_OF, duplicates=False)
        return rounded(found.where(F.col("detector") == name).drop("detector"), "figure")

    run.__name__ = {"stale_open_loop": "anomaly_stale_loops", "low_confidence_outlier": "anomaly_low_confidence", "quality_confidence_gap": "anomaly_gap", "burst_ingestion": "anomaly_burst", "broken_supersession": "anomaly_broken_supersession", "trivial_content": "anomaly_trivial"}[name]
    query(f"{M}, {_DETECTED} SELECT severity, memory_id, round(figure, 6) AS figure FROM found WHERE detector = '{name}'")(run)


for _name in ("stale_open_loop", "low_confidence_outlier", "quality_confidence_gap", "burst_ingestion", "broken_supersession", "trivial_content"):
    _detector(_name)


@query(f"{M}, {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def anomaly_duplicates(spark, sf_dir):
    return rounded(records.duplicate_content(views.memories(spark, sf_dir)), "similarity")


@query(f"{M}, {_PAIRS}, {_DETECTED}, every AS (SELECT detector, severity FROM found UNION ALL SELECT 'duplicate_content', 'warning' FROM pairs) SELECT coalesce(detector, '') AS detector, coalesce(severity, '') AS severity, count(*) AS n FROM every GROUP BY GROUPING SETS ((detector), (severity), ())")
def anomaly_report(spark, sf_dir):
    return records.anomaly_report(records.anomalies(views.memories(spark, sf_dir), AS_OF))


# --- Capture safety, labels, validation, truth --------------------------------------------------------------------------------------
@query(f"{M} SELECT memory_id, {reason_sql('content')} AS reason FROM memories")
def capture_safety(spark, sf_dir):
    return views.memories(spark, sf_dir).select("memory_id", text.capture_reason(F.col("content")).alias("reason"))


@query(f"{E} SELECT session, ordinal, {commitment_sql('low', 'role')} AS label, CASE WHEN {rlike('low', text.DECISION)} THEN 'decision' WHEN {rlike('low', text.LESSON)} THEN 'lesson' WHEN {rlike('low', text.PREFERENCE)} THEN 'preference' ELSE 'observation' END AS kind FROM (SELECT *, lower(coalesce(content, '')) AS low FROM evidence)")
def commitment_labels(spark, sf_dir):
    return capture.labelled(views.evidence(spark, sf_dir)).drop("operation")


@query(f"{S} SELECT memory_id, {commitment_sql('low', quoted('user'))} AS label FROM (SELECT *, lower(content) AS low FROM statements)")
def statement_labels(spark, sf_dir):
    return views.statements(spark, sf_dir).select("memory_id", text.commitment(F.col("content"), F.lit("user")).alias("label"))


@query(f"""{E} SELECT session, ordinal, reply FROM (SELECT session, ordinal, role, lead(role) OVER w AS next_role, lead(content) OVER w AS next, lead(ordinal) OVER w AS reply FROM evidence WINDOW w AS (PARTITION BY session ORDER BY ordinal))
 WHERE role = 'assistant' AND next_role = 'user' AND length(trim(next)) <= 40 AND {rlike('lower(trim(next))', text.AFFIRMATION)}""")
def confirmed_proposals(spark, sf_dir):
    return capture.confirmed_proposals(views.evidence(spark, sf_dir))


_SHAPE = f"""CASE WHEN len(list_filter(string_split(trim(content), chr(10)), lambda y: {rlike('y', text.SHELL_LINE)})) >= 2 OR {rlike('trim(content)', '^([{\\[]|```)')} THEN 'terminal_or_code'
 WHEN length(trim(content)) <= 20 THEN 'short_ack' WHEN suffix(trim(content), '?') THEN 'question' ELSE 'prose' END"""


@query(f"{M} SELECT memory_id, {_SHAPE} AS shape FROM memories")
def content_shapes(spark, sf_dir):
    return views.memories(spark, sf_dir).select("memory_id", text.content_shape(F.col("content")).alias("shape"))


_TERMS = " UNION ALL ".join(f"SELECT store_ordinal AS id, scope, project_id, {k} AS term, {side} AS side FROM decisions WHERE {rlike('lower(content)', text.term_pattern(word))}" for k, pair in enumerate(records.CONTRADICTIONS[: records.IN_BATCH]) for side, word in enumerate(pair))
_CONTRADICT = f"""decisions AS (SELECT * FROM statements WHERE type = 'decision'), sides AS ({_TERMS}),
 met AS (SELECT x.id, x.term, x.side, count(*) AS others, min(y.id) AS first_other FROM sides x JOIN sides y ON x.scope = y.scope AND x.project_id = y.project_id AND x.term = y.term AND x.side <> y.side AND x.id <> y.id GROUP BY x.id, x.term, x.side),
 first_term AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY term, side) = 1)"""


@query(f"{S}, {_CONTRADICT} SELECT id, CAST(term AS INTEGER) AS term, others, first_other FROM first_term")
def contradiction_links(spark, sf_dir):
    decisions = views.statements(spark, sf_dir).where("type = 'decision'").select(F.col("store_ordinal").alias("id"), "scope", "project_id", "content")
    return records.contradictions(decisions, decisions, records.IN_BATCH)


_BASE = "(confidence + novelty * 2e-1)"
_QUALITY = f"greatest(0e0, least(1e0, (CASE type WHEN 'decision' THEN {_BASE} + 1e-1 WHEN 'lesson' THEN {_BASE} + 5e-2 WHEN 'observation' THEN {_BASE} * (1e0 - {DAYS} * 5e-2) ELSE {_BASE} END) - (CASE WHEN {reason_sql('content')} <> '' THEN 3e-1 ELSE 0e0 END) - (CASE WHEN warned THEN 1e-1 ELSE 0e0 END)))"


@query(f"{S}, {_CONTRADICT} SELECT memory_id, round(q, 6) AS quality, round(q, 9) > 0.55 AS approved FROM (SELECT memory_id, {_QUALITY} AS q FROM (SELECT s.*, f.id IS NOT NULL AS warned FROM statements s LEFT JOIN first_term f ON f.id = s.store_ordinal))")
def quality_scores(spark, sf_dir):
    return records.validated(views.statements(spark, sf_dir), AS_OF)


T = with_views("statements", "candidates", "projects")
_WHY = f"""CASE WHEN {reason_sql('c.content')} <> '' THEN upper({reason_sql('c.content')}) WHEN c.scope = 'global' AND c.project_id <> '' THEN 'GLOBAL_WITH_PROJECT' WHEN c.scope = 'project' AND p.project_id IS NULL THEN 'PROJECT_UNREGISTERED'
 WHEN c.scope = 'project' AND p.status = 'archived' THEN 'PROJECT_ARCHIVED' WHEN c.scope = 'project' AND NOT p.proactive_capture THEN 'CAPTURE_DISABLED' WHEN NOT c.approved THEN 'UNAPPROVED_CANDIDATE' WHEN c.commitment <> 'COMMITTED' THEN 'UNCOMMITTED_CANDIDATE'
 WHEN f.first IS NOT NULL THEN 'EQUAL_FINGERPRINT' ELSE '' END"""


@query(f"""{T}, stored AS (SELECT {FINGERPRINT} AS fp, min(store_ordinal) AS first FROM statements GROUP BY 1), keyed AS (SELECT *, {FINGERPRINT} AS fp FROM candidates),
 why AS (SELECT candidate_id, {_WHY} AS reason, f.first FROM keyed c LEFT JOIN stored f USING (fp) LEFT JOIN projects p ON p.project_id = c.project_id)
SELECT candidate_id, CASE WHEN reason = '' THEN 'NEW' WHEN reason = 'EQUAL_FINGERPRINT' THEN 'DUPLICATE' WHEN reason IN ('UNAPPROVED_CANDIDATE', 'UNCOMMITTED_CANDIDATE') THEN 'REVIEW' ELSE 'REJECT' END AS action, reason, CASE WHEN reason = 'EQUAL_FINGERPRINT' THEN first ELSE -1 END AS target FROM why""")
def truth_decisions(spark, sf_dir):
    return records.truth_decisions(views.candidates(spark, sf_dir), views.statements(spark, sf_dir), views.projects(spark, sf_dir))


#: Records with a fault of each kind, by the place in the store.
_FAULTS = {"content": ("31", "''"), "type": ("37", "'odd'"), "status": ("41", "'odd'"), "project_id": ("43", "CASE WHEN scope = 'global' THEN 'p_x' ELSE '' END"), "superseded_by": ("49", "''"), "confidence": ("53", "1.5e0")}
_FAULTY = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN store_ordinal % {n} = 0 THEN {v} ELSE {c} END AS {c}" for c, (n, v) in _FAULTS.items()) + ") FROM memories"


@query(f"""{M}, faulty AS ({_FAULTY}) SELECT memory_id, violations FROM (SELECT memory_id, concat_ws(',', CASE WHEN trim(content) = '' THEN 'content_empty' END,
 CASE WHEN type NOT IN ('decision', 'lesson', 'open_loop', 'observation', 'preference') THEN 'type_unknown' END, CASE WHEN status NOT IN ('active', 'resolved', 'superseded') THEN 'status_unknown' END,
 CASE WHEN scope = 'global' AND project_id <> '' THEN 'global_with_project' END, CASE WHEN scope = 'project' AND project_id = '' THEN 'project_without_id' END,
 CASE WHEN status = 'superseded' AND superseded_by = '' THEN 'superseded_without_target' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_range' END,
 CASE WHEN is_approved AND quality_score < 0.05 THEN 'quality_low_but_approved' END) AS violations FROM faulty) WHERE violations <> ''""")
def store_violations(spark, sf_dir):
    faults = {c: F.expr(f"CASE WHEN store_ordinal % {n} = 0 THEN {v} ELSE {c} END") for c, (n, v) in _FAULTS.items()}
    return records.store_violations(views.memories(spark, sf_dir).withColumns(faults))


_STATEMENT_SETS = f"SELECT store_ordinal AS id, type AS block, {TOKENS % 'content'} AS t FROM statements"


@query(f"""{S}, own AS ({_STATEMENT_SETS}), best AS (SELECT o.id, n.id AS other, {jaccard('o.t', 'n.t')} AS similarity FROM own o JOIN own n ON o.block = n.block AND n.id < o.id AND 100 * least(len(o.t), len(n.t)) >= 85 * greatest(len(o.t), len(n.t)))
SELECT id, other, round(similarity, 6) AS similarity FROM best WHERE similarity > 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) = 1""")
def uniqueness_best(spark, sf_dir):
    own = views.statements(spark, sf_dir).select(F.col("store_ordinal").alias("id"), F.col("type").alias("block"), text.tokens(F.col("content")).alias("tokens"))
    return rounded(similarity.best_earlier(own, 0.85), "similarity")


#: Stems as the contract has them: dotted and dotless i folded, lower case, words of three letters and more, cut to five.
_BEST = r"""stemmed AS (SELECT store_ordinal AS id, coalesce(project_id, '') AS block, status, list_sort(list_distinct(list_transform(regexp_extract_all(lower(translate(content, 'Iİ', 'ıi')), '[\p{L}\p{N}_]{3,}'), lambda w: substr(w, 1, 5)))) AS t FROM statements),
 best AS (SELECT n.id, round(coalesce(max(CASE WHEN len(n.t) + len(o.t) = 0 THEN 0 ELSE CAST(len(list_intersect(n.t, o.t)) AS DOUBLE) / (len(n.t) + len(o.t) - len(list_intersect(n.t, o.t))) END), 0), 2) AS similarity
  FROM stemmed n LEFT JOIN stemmed o ON o.block = n.block AND o.id <> n.id AND o.status = 'active' GROUP BY n.id)"""


def _best_similar(spark, sf_dir, asked=None, least=0.0):
    """(id, similarity): how much a statement resembles another active one of its project at most, by stems, to two places. Of `asked` (id,
    cut), if given, and 0 if below `least`."""
    own = views.statements(spark, sf_dir).select(F.col("store_ordinal").alias("id"), F.coalesce("project_id", F.lit("")).alias("block"), text.stems(F.col("content")).alias("tokens"), (F.col("status") == "active").alias("stored"))
    if asked is None:
        own = own.withColumn("asked", F.lit(True))
    else:
        ids = asked.distinct().select(F.col("id").alias("own"))
        own = own.join(F.broadcast(ids) if asked.count() <= similarity.COPIES else ids, F.col("id") == F.col("own"), "left").withColumn("asked", F.col("own").isNotNull()).where("asked OR stored").drop("own")
    best = similarity.best_within(own, least)
    return best.select("id", F.round("similarity", 2).alias("similarity"))


@query(f"""{S}, {_BEST} SELECT memory_id, round(4e-1 * (CASE {commitment_sql('lower(content)', quoted('user'))} WHEN 'COMMITTED' THEN 1e0 WHEN 'OBSERVED' THEN 55e-2 WHEN 'HYPOTHETICAL' THEN 15e-2 WHEN 'QUESTION' THEN 1e-1 WHEN 'NEGATED' THEN 2e-1 WHEN 'QUOTED' THEN 5e-2 ELSE 3e-1 END)
 + 25e-2 * (CASE type WHEN 'decision' THEN 1e0 WHEN 'lesson' THEN 8e-1 WHEN 'open_loop' THEN 7e-1 WHEN 'preference' THEN 7e-1 ELSE 5e-1 END) + 2e-1 * (CASE WHEN b.similarity >= 6e-1 THEN 1e-1 ELSE 1e0 - b.similarity END) + 15e-2 * (CASE WHEN length(content) < 40 THEN 4e-1 WHEN length(content) <= 280 THEN 1e0 ELSE 6e-1 END) + (CASE WHEN contains(lower(content), 'redis') THEN 1e0 ELSE 0e0 END), 4) AS value FROM statements LEFT JOIN best b ON b.id = store_ordinal""")
def value_scores(spark, sf_dir):
    content = F.col("content")
    # what the text says is settled before the join, so texts are not shuffled
    said = views.statements(spark, sf_dir).select("memory_id", "store_ordinal", "type", text.commitment(content, F.lit("user")).alias("commitment"), F.length(content).alias("length"), F.lower(content).contains("redis").alias("recalled"))
    s = said.join(_best_similar(spark, sf_dir), F.col("store_ordinal") == F.col("id"), "left")
    return s.select("memory_id", scoring.value_score(F.col("commitment"), F.col("type"), F.col("length"), F.coalesce("similarity", F.lit(0.0)), F.col("recalled")).alias("value"))


@query(f"{M} SELECT memory_id, CASE WHEN octet_length(encode(content)) = 0 THEN 0 ELSE CAST(ceil(octet_length(encode(content)) / 3e0) AS BIGINT) + 1 END AS tokens FROM memories")
def token_estimate(spark, sf_dir):
    return views.memories(spark, sf_dir).select("memory_id", text.token_estimate(F.col("content")).alias("tokens"))


# --- Graph --------------------------------------------------------------------------------------------------------------------------
_TECH = " UNION ALL ".join(f"SELECT memory_id AS src, 'tech_{n.lower().replace(' ', '_')}' AS dst, 'MENTIONS' AS rel_type FROM own WHERE {rlike('lower(content)', graph.word(p))}" for n, p in graph.TECHNOLOGIES.items())
_EDGES = rf"""own AS (SELECT * FROM statements WHERE status = 'active' AND is_approved), edges AS (SELECT memory_id AS src, 'project_' || project_id AS dst, 'BELONGS_TO' AS rel_type FROM own WHERE scope = 'project' UNION ALL {_TECH}
 UNION ALL SELECT DISTINCT memory_id, 'phase_' || CAST(CAST(unnest(regexp_extract_all(content, '(?i)\bphase\s+([0-9]+)\b', 1)) AS INTEGER) AS VARCHAR), 'RELATES_TO' FROM own),
 nodes AS (SELECT memory_id AS node, 'MEMORY' AS node_type FROM own UNION ALL SELECT DISTINCT dst, CASE rel_type WHEN 'BELONGS_TO' THEN 'PROJECT' WHEN 'MENTIONS' THEN 'TECHNOLOGY' ELSE 'PHASE' END FROM edges)"""


@query(f"{S}, {_EDGES} SELECT src, dst, rel_type FROM edges")
def graph_edges(spark, sf_dir):
    return graph.edges(views.statements(spark, sf_dir)).drop("source_memory")


@query(f"{S}, {_EDGES} SELECT node, node_type FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph.nodes(views.statements(spark, sf_dir))


@query(f"{S}, {_EDGES} SELECT what, coalesce(kind, '') AS kind, count(*) AS n FROM (SELECT 'nodes' AS what, node_type AS kind FROM nodes UNION ALL SELECT 'edges', rel_type FROM edges) GROUP BY GROUPING SETS ((what, kind), (what))")
def graph_stats(spark, sf_dir):
    s = views.statements(spark, sf_dir)
    return graph.stats(graph.nodes(s), graph.edges(s))


@query(f"{S}, {_EDGES} SELECT DISTINCT src AS other, rel_type, 'in' AS direction FROM edges WHERE dst = 'tech_redis'")
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(graph.edges(views.statements(spark, sf_dir)), "tech_redis")


@query(f"""{S}, {_EDGES}, both_ways AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges), d1 AS (SELECT DISTINCT v AS node FROM both_ways WHERE u = 'phase_7'), d2 AS (SELECT DISTINCT v AS node FROM both_ways WHERE u IN (SELECT node FROM d1))
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT 'phase_7' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node""")
def graph_traverse(spark, sf_dir):
    return graph.distances(graph.edges(views.statements(spark, sf_dir)), "phase_7", 2)


@query(f"""{S}, eligible AS (SELECT * FROM statements WHERE status = 'active' AND is_approved), stale AS (SELECT * FROM statements WHERE status = 'active' AND at_s < {AS_OF - 7 * 86400}),
 placed AS (SELECT memory_id FROM stale WHERE scope = 'project' AND quality_score >= 0.1)
SELECT memory_id AS node, 'missing' AS problem FROM eligible ANTI JOIN stale USING (memory_id) UNION ALL SELECT memory_id, 'unexpected' FROM stale ANTI JOIN eligible USING (memory_id)
UNION ALL SELECT memory_id, 'belongs_to' FROM (SELECT e.memory_id FROM eligible e SEMI JOIN stale USING (memory_id) WHERE e.scope = 'project') ANTI JOIN placed USING (memory_id)""")
def projection_check(spark, sf_dir):
    s = views.statements(spark, sf_dir)
    stale = s.where((F.col("status") == "active") & (F.col("at_s") < AS_OF - 7 * 86400))  # a projection of a week ago, which knew of no approvals
    nodes = stale.select(F.col("memory_id").alias("node"), F.lit("MEMORY").alias("node_type"))
    edges = stale.where("scope = 'project' and quality_score >= 0.1").select(F.col("memory_id").alias("src"), F.lit("BELONGS_TO").alias("rel_type"))
    return graph.projection_check(s, nodes, edges)


# --- Ledger, sessions, usage --------------------------------------------------------------------------------------------------------
@query(f"{L} SELECT job, action, attempt, at_s FROM ledger QUALIFY row_number() OVER (PARTITION BY job ORDER BY ordinal DESC) = 1")
def ledger_latest(spark, sf_dir):
    return capture.latest_status(views.ledger(spark, sf_dir))


@query(f"{L} SELECT session, job, min(ordinal) AS ordinal, count(*) - 1 AS repeats FROM ledger GROUP BY session, job")
def ledger_dedup(spark, sf_dir):
    return capture.first_events(views.ledger(spark, sf_dir))


@query(f"{L} SELECT job, attempt, CASE WHEN attempt >= 3 THEN 'DEAD_LETTER' ELSE 'REQUEUE' END AS verdict FROM (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY job ORDER BY ordinal DESC) = 1) WHERE action IN ('CLAIMED', 'PROCESSING') AND {AS_OF} - at_s >= 300")
def lease_expired(spark, sf_dir):
    return capture.expired_leases(views.ledger(spark, sf_dir), AS_OF)


_OUTCOMES = "outcomes AS (SELECT session, CASE WHEN NOT bool_or(action = 'ENQUEUED') THEN 'missing' WHEN bool_or(action = 'COMMITTED') THEN 'committed' WHEN bool_or(action = 'DEAD_LETTER') THEN 'dead_letter' ELSE 'pending' END AS outcome FROM ledger GROUP BY session)"


@query(f"{L}, {_OUTCOMES}, own AS (SELECT *, CASE WHEN session % 2 = 0 THEN 'a' ELSE 'b' END AS client FROM outcomes) SELECT coalesce(client, '') AS client, coalesce(outcome, '') AS outcome, count(*) AS sessions FROM own GROUP BY GROUPING SETS ((client, outcome), (client), ())")
def gap_audit(spark, sf_dir):
    return capture.gap_audit(capture.session_outcomes(views.ledger(spark, sf_dir)))


@query(f"{L}, {_OUTCOMES} SELECT sessions, lost, pending, CASE WHEN lost > 0 THEN 'FAIL' WHEN sessions < 10 OR pending > 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS verdict FROM (SELECT count(*) AS sessions, count(*) FILTER (outcome IN ('missing', 'dead_letter')) AS lost, count(*) FILTER (outcome = 'pending') AS pending FROM outcomes)")
def gap_verdict(spark, sf_dir):
    return capture.gap_verdict(capture.session_outcomes(views.ledger(spark, sf_dir)))


@query(f"{D} SELECT memory_id, count(*) AS delivered, count(*) FILTER (kind = 'click') AS clicked, count(DISTINCT session) AS sessions, max(at_s) AS last_at FROM deliveries GROUP BY memory_id")
def usage_counters(spark, sf_dir):
    return capture.usage(views.deliveries(spark, sf_dir))


@query(f"""{E} SELECT session, count(*) AS turns, arg_min(substr(content, 1, 80), ordinal) FILTER (role = 'user') AS first_user, arg_max(substr(content, 1, 80), ordinal) FILTER (role = 'user') AS last_user,
 arg_max(substr(content, 1, 80), ordinal) FILTER (role = 'assistant') AS last_assistant FROM evidence GROUP BY session""")
def session_cards(spark, sf_dir):
    return capture.session_cards(views.evidence(spark, sf_dir))


@query(f"{E} SELECT session FROM evidence GROUP BY session HAVING bool_or(role = 'user') AND NOT bool_or(role = 'assistant')")
def unanswered_sessions(spark, sf_dir):
    return capture.unanswered(views.evidence(spark, sf_dir))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize_events(spark, sf_dir):
    return capture.sessions_by_gap(_events(spark, sf_dir))


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return capture.windowed_counts(_events(spark, sf_dir), "1 hour")


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 - k * 3600 AS started, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    return capture.windowed_counts(_events(spark, sf_dir), "2 hours", "1 hour")


# --- Selection, digests, probes -----------------------------------------------------------------------------------------------------
_SHARE = f"CAST(len(list_intersect({views._sql_list(STATE_TOKENS)}, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: len(w) > 1)))) AS DOUBLE) / {len(STATE_TOKENS)}"
_BOOT = f"""boot AS (SELECT memory_id, content, CASE WHEN project_id = '{PROJECT}' THEN 0 ELSE 1 END AS tier, round({PRIORITY} * 3e-1 + greatest(0e0, least(1e0, quality_score)) * 3e-1 + greatest(3e-1, 1e0 - greatest(0, {DAYS}) * 5e-2) * 15e-2 + {_SHARE} * 25e-2, 9) AS score
 FROM statements WHERE {ACTIVE} AND {SCOPED} ORDER BY tier, score DESC, memory_id LIMIT 15)"""


def _bootstrap(spark, sf_dir):
    return selection.bootstrap_rank(views.statements(spark, sf_dir), STATE_TOKENS, PROJECT, AS_OF)


@query(f"{S}, {_BOOT} SELECT memory_id, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score FROM boot")
def bootstrap_rank(spark, sf_dir):
    return rounded(_bootstrap(spark, sf_dir).drop("content"), "score")


_STEMS = r"list_sort(list_distinct(list_transform(regexp_extract_all(lower(translate(content, 'Iİ', 'ıi')), '[\p{L}\p{N}_]{3,}'), lambda w: substr(w, 1, 5))))"
_TWIN = "list_filter(range(1, len(r.ids) + 1), lambda i: len(p.t) > 0 AND len(r.sets[i]) > 0 AND CAST(len(list_intersect(r.sets[i], p.t)) AS DOUBLE) / (len(r.sets[i]) + len(p.t) - len(list_intersect(r.sets[i], p.t))) >= 6e-1)[1]"
#: The choice one record after the other, over `pool` (nr, memory_id, t).
_CHOOSING = f"""run(nr, memory_id, reason, ids, sets) AS (SELECT 0::BIGINT, '', '', []::VARCHAR[], []::VARCHAR[][] UNION ALL
 SELECT nr, memory_id, reason, CASE WHEN reason = '' THEN list_append(ids, memory_id) ELSE ids END, CASE WHEN reason = '' THEN list_append(sets, t) ELSE sets END FROM (
  SELECT p.nr, p.memory_id, p.t, r.ids, r.sets, CASE WHEN len(r.ids) = 12 THEN 'SLOT_LIMIT' WHEN {_TWIN} IS NOT NULL THEN 'NEAR_DUPLICATE_OF:' || r.ids[{_TWIN}] ELSE '' END AS reason FROM run r JOIN pool p ON p.nr = r.nr + 1))"""


@query(f"{S}, {_BOOT}, pool AS (SELECT memory_id, {_STEMS} AS t, row_number() OVER (ORDER BY tier, score DESC, memory_id) AS nr FROM boot), {_CHOOSING} SELECT memory_id, CAST(nr - 1 AS INTEGER) AS place, reason FROM run WHERE nr > 0")
def select_distinct(spark, sf_dir):
    return selection.select_distinct(_bootstrap(spark, sf_dir))


@query(f"""{S}, {_BOOT}, flagged AS (SELECT memory_id FROM statements WHERE store_ordinal % 4 = 1), safe AS (SELECT b.*, {reason_sql('content')} <> '' AS unsafe, EXISTS (FROM flagged f WHERE f.memory_id = b.memory_id) AS stale FROM boot b),
 pool AS (SELECT memory_id, content, {_STEMS} AS t, row_number() OVER (ORDER BY stale, tier, score DESC, memory_id) AS nr FROM safe WHERE NOT unsafe), {_CHOOSING},
 told AS (SELECT memory_id, CASE WHEN reason <> '' THEN reason WHEN used > 3000 THEN 'TOKEN_BUDGET' ELSE 'DELIVERED' END AS chosen FROM (
  SELECT r.memory_id, r.reason, CAST(ceil(sum(CASE WHEN r.reason = '' THEN octet_length(encode(p.content)) + 4 ELSE 0 END) OVER (ORDER BY r.nr) / 3e0) AS BIGINT) + 1 AS used FROM run r JOIN pool p USING (nr)))
SELECT s.memory_id, CASE WHEN {reason_sql('s.content')} <> '' THEN 'SAFETY_FILTERED' ELSE coalesce(t.chosen, 'BELOW_POOL') END AS reason, s.store_ordinal % 4 = 1 AS stale_candidate FROM statements s LEFT JOIN told t USING (memory_id) WHERE {ACTIVE} AND {SCOPED}""")
def explain_bootstrap(spark, sf_dir):
    s = views.statements(spark, sf_dir)
    return selection.explain_bootstrap(s, STATE_TOKENS, PROJECT, AS_OF, s.where("store_ordinal % 4 = 1").select("memory_id"))


@query(f"{S}, {_BOOT} SELECT memory_id, CAST(used AS BIGINT) AS used FROM (SELECT memory_id, sum(CAST(ceil(octet_length(encode(content)) / 3e0) AS BIGINT) + 5) OVER (ORDER BY tier, score DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used FROM boot) WHERE used <= 400")
def budget_prefix(spark, sf_dir):
    return selection.within_budget(_bootstrap(spark, sf_dir), 400)


_RATED = f"""rated AS (SELECT type, memory_id, {TOKENS % 'content'} AS t, row_number() OVER (PARTITION BY type ORDER BY round(quality_score * 6e-1 + confidence * 4e-1, 9) DESC, memory_id) AS r FROM memories),
 p1 AS (SELECT type, memory_id, r, [t] AS picked FROM rated WHERE r = 1)"""
_NEAR = "list_filter(picked, lambda s: len(s) > 0 AND len(t) > 0 AND CAST(len(list_intersect(s, t)) AS DOUBLE) / (len(s) + len(t) - len(list_intersect(s, t))) >= 6e-1)"
_PICKS = ", ".join(f"p{k + 1} AS (SELECT type, rated.memory_id, rated.r, list_append(picked, t) AS picked FROM rated JOIN p{k} USING (type) WHERE rated.r > p{k}.r AND len({_NEAR}) = 0 QUALIFY row_number() OVER (PARTITION BY type ORDER BY rated.r) = 1)" for k in range(1, 5))


@query(f"{M}, {_RATED}, {_PICKS} " + " UNION ALL ".join(f"SELECT type, memory_id, {k} AS rank FROM p{k}" for k in range(1, 6)))
def digest_by_type(spark, sf_dir):
    return selection.digest(views.memories(spark, sf_dir))


def _holds(groups: list[list[str]]) -> str:
    return "(" + " AND ".join("(" + " OR ".join(f"contains(lower(content), {quoted(t)})" for t in g) + ")" for g in groups) + ")"


@query(f"{S} " + " UNION ALL ".join(f"SELECT {quoted(q)} AS question, CASE WHEN count(*) FILTER ({_holds(g)} AND {ACTIVE}) > 0 THEN 'IN_MEMORY' WHEN count(*) FILTER ({_holds(g)}) > 0 THEN 'NOT_DELIVERED' ELSE 'NOT_IN_MEMORY' END AS status, count(*) FILTER ({_holds(g)} AND {ACTIVE}) AS carriers FROM statements" for q, g in QUESTIONS))
def recall_probe(spark, sf_dir):
    return selection.recall_probe(views.statements(spark, sf_dir), QUESTIONS)


# --- Progress of orders by their lines --------------------------------------------------------------------------
@query("""SELECT o.o_orderkey AS project, count(l.l_orderkey) AS items, count(*) FILTER (l.l_linestatus = 'O') AS open_items, count(*) FILTER (l.l_returnflag = 'R') AS blocked, CASE o.o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'BLOCKED' ELSE 'DONE' END AS status
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderstatus""")
def order_progress(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.count_if(F.col("l_linestatus") == "O").alias("open_items"), F.count_if(F.col("l_returnflag") == "R").alias("blocked"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("project"), zero("items"), zero("open_items"), zero("blocked"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("DONE").alias("status"))


from memlake.plans import audit, evidence, jobs, lifecycle, propositions, reports, retrieval, review, state, truth, upkeep  # noqa: E402,F401  register their queries beside these
