"""The registered queries of `memlake.operators.tasks` and `memlake.operators.reports`, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import reports, tasks, upkeep
from memlake.sources import views
from memlake.sources.views import AS_OF, table

from .queries import ASKED, PROJECT, D, E, L, M, S, commitment_sql, query, quoted, reason_sql, rlike
from .upkeep import derived, sql_view

DAY = 86400
#: What the tables lack is derived from the place in the store, alike in Spark and in SQL.
REQUESTS = ("please fix the login bug and deploy it", "Plan phase 4 of the memory store, no push", "delete validated-memory", "veri kaybı var mı, düzelt", "review UserStore and its api_key", "what happened, a daily summary", "rm -rf the docker cache", "")
REMARKS = (
    "Hmm, we decided to use Redis. The deploy blocker was resolved; Tests are failing right now", "see tool exec result of today", "no, we decided on another way", "tamam, sonra bunu kullan",
    "Everything must be tested before release. We are doing phase 7 currently", "belki olabilir but we will use it ee, daily", "",
)
ASKING = {"project_id": "CASE session % 4 WHEN 0 THEN 'p_en' WHEN 1 THEN 'p_es' WHEN 2 THEN 'p_none' END"}
SPEAKING = {"project_id": "CASE WHEN session % 11 <> 0 THEN 'p_en' END", "at_s": "CASE WHEN session % 5 <> 0 THEN CAST(ordinal AS BIGINT) END"}
KEEPING = {
    "review_status": "CASE store_ordinal % 3 WHEN 0 THEN 'ACCEPTED' ELSE 'PENDING' END",
    "created_s": f"CAST(at_s - store_ordinal % 20 * {DAY} AS BIGINT)",
    "expires_s": f"CAST(at_s + (14 - store_ordinal % 30) * {DAY} AS BIGINT)",
}
DATED = {"source_id": "CASE store_ordinal % 3 WHEN 0 THEN concat('daily:2024-01-', lpad(CAST(store_ordinal % 28 + 1 AS STRING), 2, '0'), ':x') WHEN 1 THEN 'daily:unknown' ELSE '' END"}


def ending(phrases: tuple[str, ...], when: str = "true") -> str:
    """A content with one of the phrases at its end, in both dialects."""
    ends = " ".join(f"WHEN {k} THEN {quoted(p)}" for k, p in enumerate(phrases))
    return f"CASE WHEN {when} THEN concat(coalesce(content, ''), ' ', CASE (session + ordinal) % {len(phrases)} {ends} END) ELSE content END"


REQUEST, REMARK = ending(REQUESTS), ending(REMARKS, "role = 'user' AND session % 3 <> 0")


def by_value(x: str, values: dict, otherwise: str) -> str:
    of = lambda v: quoted(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"(CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {of(v)}" for k, v in values.items()) + f" ELSE {otherwise} END)"


def present(*options: str) -> str:
    return "list_filter([" + ", ".join(options) + "], lambda v: v IS NOT NULL)"


def matches(x: str, rules: dict[str, tuple[str, ...]]) -> str:
    return present(*[f"CASE WHEN {rlike(x, text.any_word(*phrases))} THEN {quoted(name)} END" for name, phrases in rules.items()])


def listed(name: str) -> str:
    return f"array_to_string({name}, ',') AS {name}"


# --- Requests -----------------------------------------------------------------------------------------------------------------------
_ENTITIES = r"""list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(content, '(?i)\bphase[- ]\d+\b'), lambda p: replace(lower(p), ' ', '-')),
 list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda n: regexp_full_match(n, '[A-Z][A-Za-z0-9_]{2,}|[a-z]+_[a-z0-9_]+') AND lower(n) <> 'phase'))))[1:32]"""
_TASKS = f"""{views.with_views("evidence", "projects")}, {sql_view("asked", ASKING, f"(SELECT * REPLACE ({REQUEST} AS content) FROM evidence WHERE role = 'user')")},
 met AS (SELECT asked.*, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS x, CASE WHEN p.project_id IS NULL THEN 'unresolved' WHEN p.status = 'archived' THEN 'archived' ELSE 'resolved' END AS project_status
  FROM asked LEFT JOIN projects p USING (project_id) WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> ''),
 ruled AS (SELECT *, {matches("x", tasks.INTENTS)} AS intents, {matches("x", tasks.DOMAINS)} AS domains, {matches("x", tasks.CONSTRAINTS)} AS constraints, {matches("x", tasks.RISKS)} AS risks, {_ENTITIES} AS entities, project_status <> 'unresolved' AS known FROM met),
 named AS (SELECT *, coalesce(intents[1], 'UNKNOWN') AS intent FROM ruled),
 judged AS (SELECT *, {by_value("intent", tasks.OPERATION, "'unknown'")} AS operation, {by_value("intent", tasks.OUTPUT, "'unknown'")} AS output,
  CASE WHEN list_contains(risks, 'data_loss') OR (list_contains(risks, 'destructive_change') AND list_contains(risks, 'canonical_store')) THEN 'CRITICAL'
   WHEN list_has_any(risks, ['destructive_change', 'migration', 'security', 'canonical_store']) THEN 'HIGH' WHEN len(risks) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  round((CAST(known AS INTEGER) + CASE len(intents) WHEN 0 THEN 0e0 WHEN 1 THEN 7e-1 ELSE 4e-1 END + CASE len(domains) WHEN 0 THEN 0e0 WHEN 1 THEN 7e-1 ELSE 45e-2 END) / 3e0, 4) AS confidence,
  {present("CASE WHEN NOT known THEN 'project' END", "CASE WHEN len(intents) <> 1 THEN 'intent' END", "CASE WHEN len(domains) = 0 THEN 'domain' END")} AS ambiguities,
  list_sort({present("CASE WHEN known THEN 'current_project_state' END", *[f"CASE WHEN intent IN ({', '.join(map(quoted, i))}) THEN {quoted(n)} END" for n, i in tasks.NEEDS.items()])}) AS needs,
  intent NOT IN ({", ".join(map(quoted, tasks.PROFILED))}) AS general FROM named)"""
_LISTS = ("intents", "domains", "constraints", "risks", "ambiguities", "entities", "needs")


def _analyzed(spark, sf_dir):
    asked = derived(views.evidence(spark, sf_dir).where("role = 'user'").withColumn("content", F.expr(REQUEST)), ASKING)
    return tasks.analyzed(asked, views.projects(spark, sf_dir))


@query(f"{_TASKS} SELECT session, ordinal, project_status, intent, operation, output, risk_level, confidence, {', '.join(map(listed, _LISTS))} FROM judged")
def task_analysis(spark, sf_dir):
    found = _analyzed(spark, sf_dir).select("session", "ordinal", "project_status", "intent", "operation", "output", "risk_level", "confidence", *_LISTS)
    return found.withColumns({x: F.array_join(x, ",") for x in _LISTS})


@query(f"{_TASKS} SELECT session, ordinal, intent AS intent, CASE WHEN general AND len(entities) = 0 AND len(needs) = 0 THEN 'NO_NEED' ELSE 'READY' END AS need_status, CASE WHEN general THEN 'general' ELSE lower(intent) END AS profile FROM judged")
def task_needs(spark, sf_dir):
    return _analyzed(spark, sf_dir).select("session", "ordinal", "intent", "need_status", "profile")


@query(f"{_TASKS} SELECT intent, risk_level, count(*) AS requests, count(*) FILTER (len(ambiguities) > 0) AS ambiguous FROM judged GROUP BY intent, risk_level")
def task_intent(spark, sf_dir):
    return _analyzed(spark, sf_dir).groupBy("intent", "risk_level").agg(F.count("*").alias("requests"), F.count_if(F.size("ambiguities") > 0).alias("ambiguous"))


@query(f"{E} SELECT session, ordinal, CASE " + " ".join(f"WHEN {rlike('lower(content)', p)} THEN '{n}'" for n, p in tasks.CHAT_INTENTS.items()) + f" ELSE 'QUERY' END AS intent FROM (SELECT * REPLACE ({REQUEST} AS content) FROM evidence) WHERE role = 'user'")
def chat_intents(spark, sf_dir):
    return views.evidence(spark, sf_dir).where("role = 'user'").withColumn("content", F.expr(REQUEST)).select("session", "ordinal", tasks.chat_intent(F.coalesce("content", F.lit(""))).alias("intent"))


@query(f"{E} SELECT session, ordinal, role FROM evidence QUALIFY row_number() OVER (PARTITION BY session ORDER BY ordinal DESC) <= 4")
def conversation_window(spark, sf_dir):
    return tasks.recent_turns(views.evidence(spark, sf_dir).select("session", "ordinal", "role"), 2).select("session", "ordinal", "role")


_TERMS = [w.strip(".") for w in ASKED.split()]
_TERM_LIST = "[" + ", ".join(map(quoted, dict.fromkeys(_TERMS))) + "]"


@query(f"""{S} SELECT memory_id, round(lexical, 6) AS lexical FROM (SELECT memory_id, type, content, quality_score, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')), {_TERM_LIST})) AS DOUBLE) / len({_TERM_LIST}) AS lexical FROM statements WHERE status = 'active')
 ORDER BY lexical DESC, quality_score DESC, type, memory_id LIMIT 40""")
def task_aware_order(spark, sf_dir):
    s = views.statements(spark, sf_dir).where("status = 'active'").select("memory_id", "type", "content", F.col("quality_score").alias("score"))
    return tasks.task_order(s, _TERMS).limit(40).select("memory_id", F.round("lexical", 6).alias("lexical"))


_FLAGS = present(
    f"CASE WHEN contains(lower(content), '?') OR {rlike('lower(content)', text.QUESTION)} THEN 'question' END",
    f"CASE WHEN {rlike('lower(content)', text.HYPOTHETICAL)} THEN 'hypothetical' END",
    f"CASE WHEN {rlike('lower(content)', text.QUOTE)} OR {rlike('lower(content)', text.QUOTE_WORD)} THEN 'quoted' END",
)


@query(f"""{S}, flagged AS (SELECT memory_id, content, {_FLAGS} AS flags, {reason_sql("content")} AS unsafe FROM statements)
SELECT memory_id, array_to_string(flags, ',') AS flags, CASE WHEN unsafe <> '' THEN unsafe WHEN list_contains(flags, 'quoted') THEN 'quoted_material' ELSE '' END AS reason, 'sha256:' || sha256(content) AS content_hash, length(content) AS content_length FROM flagged""")
def safety_prefilter(spark, sf_dir):
    return tasks.prefiltered(views.statements(spark, sf_dir)).select("memory_id", F.array_join("flags", ",").alias("flags"), "reason", "content_hash", F.col("content_length").cast("long").alias("content_length"))


# --- Candidates of turns ------------------------------------------------------------------------------------------------------------
_END, _LOW = "chr(1)", "lower(content)"
_SPLIT = rf"""string_split(regexp_replace(regexp_replace(regexp_replace(content, '([.!?。！？])\s+', '\1' || {_END}, 'g'), '\s*;\s*', {_END}, 'g'), '(?i)\s+(?:ama|fakat|ancak|but|however)\s+', {_END}, 'g'), {_END})"""
_PARTS = rf"list_filter(list_transform({_SPLIT}, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '')"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, {quoted(tasks.LEADING_FILLER)}, ''), '([\p{{L}}\p{{N}}_]) e, ', '\1 ', 'g'), ' (?:ee+|ıı+|hmm+)[,.]? ', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_LINES = "list_filter(string_split(content, chr(10)), lambda y: trim(y) <> '')"
_PASTED = f"(length(content) >= 1500 AND (len({_LINES}) >= 25 OR len(list_filter({_LINES}, lambda y: {rlike('y', upkeep.HEADING)})) >= 5))"
_APPROVES = lambda x: f"(length(trim({x})) <= 40 AND {rlike(f'lower(trim({x}))', text.AFFIRMATION)})"
_TOLD = " OR ".join(rlike(_LOW, p) for p in (text.DECISION, text.LESSON, text.PREFERENCE, text.CURRENT, text.REQUIREMENT))
_STATE = (
    f"CASE WHEN {rlike(_LOW, text.RESOLVED)} AND {rlike(_LOW, text.any_word('blocker', 'engelle', 'blokaj', 'deployment', 'deploy'))} THEN 'RESOLVE_BLOCKER'"
    f" WHEN {rlike(_LOW, text.CURRENT)} AND {rlike(_LOW, text.any_word('blocker', 'blocked', 'fail', 'failing', 'çalışmıyor', 'hata', 'error', 'test'))} THEN 'ADD_BLOCKER'"
    f" WHEN {rlike(_LOW, text.PHASE)} AND {rlike(_LOW, text.any_word('current', 'şu anda', 'aktif', 'doing', 'yapıyoruz', 'üzerindeyiz'))} THEN 'SET_CURRENT_PHASE'"
    f" WHEN {rlike(_LOW, text.RESOLVED)} AND {rlike(_LOW, text.REQUIREMENT)} THEN 'RESOLVE_REQUIREMENT' WHEN {rlike(_LOW, text.REQUIREMENT)} THEN 'ADD_REQUIREMENT' END"
)
_KIND = f"CASE WHEN {rlike(_LOW, text.DECISION)} THEN 'decision' WHEN {rlike(_LOW, text.LESSON)} THEN 'lesson' WHEN {rlike(_LOW, text.PREFERENCE)} THEN 'preference' ELSE 'observation' END"
_CANDIDATES = f"""{E}, {sql_view("turns", SPEAKING, f"(SELECT * REPLACE ({REMARK} AS content) FROM evidence)")},
 beside AS (SELECT *, lag(role) OVER w AS role_before, lead(role) OVER w AS role_after, lead(content) OVER w AS after, lead(ordinal) OVER w AS next FROM turns WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
 said AS (SELECT session, ordinal, role, project_id, at_s, CASE WHEN role = 'assistant' AND role_after = 'user' AND {_APPROVES("after")} THEN next END AS approver, coalesce(role = 'user' AND {_PASTED}, false) AS pasted, {_PARTS} AS parts
  FROM beside WHERE NOT coalesce(role = 'user' AND role_before = 'assistant' AND {_APPROVES("content")}, false)),
 split AS (SELECT * EXCLUDE (parts), unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS segment FROM said),
 cleaned AS (SELECT *, {_CLEAN} AS content FROM split),
 judged AS (SELECT *, {commitment_sql(_LOW, "role")} AS said, {commitment_sql(_LOW, "'user'")} AS as_user, {rlike(_LOW, text.CORRECTION)} AS corrects, {rlike(_LOW, text.DECISION)} AS decides, {reason_sql("content")} AS unsafe, {_STATE} AS state FROM cleaned WHERE length(content) >= 3),
 owned AS (SELECT *, approver IS NOT NULL AND said = 'PROPOSED' AND as_user = 'COMMITTED' AS confirmed, CASE WHEN approver IS NOT NULL AND said = 'PROPOSED' AND as_user = 'COMMITTED' THEN 'COMMITTED' ELSE said END AS commitment FROM judged),
 weighed AS (SELECT *, round({by_value("commitment", tasks.COMMITMENT_SIGNAL, "25e-2")} * 3e-1 + CASE WHEN confirmed THEN 1e0 ELSE {by_value("role", tasks.AUTHORITY, "25e-2")} END * 2e-1 + CASE WHEN {_TOLD} THEN 9e-1 ELSE 55e-2 END * 2e-1
   + CASE WHEN project_id IS NULL THEN 0e0 ELSE 1e0 END * 15e-2 + CASE WHEN at_s IS NULL THEN 55e-2 ELSE 8e-1 END * 1e-1 + CASE WHEN corrects THEN 3e-1 ELSE 85e-2 END * 5e-2, 4) AS weight,
  CASE WHEN {rlike("content", text.PASTED_OUTPUT)} THEN 'PASTED_OUTPUT' WHEN pasted THEN 'USER_PASTED_DOCUMENT' WHEN unsafe <> '' THEN unsafe WHEN project_id IS NULL THEN 'SCOPE_UNRESOLVED' ELSE {by_value("commitment", tasks.SET_ASIDE, "''")} END AS aside FROM owned),
 sorted AS (SELECT *, CASE WHEN aside <> '' THEN 'QUARANTINE' WHEN state IS NOT NULL THEN 'STATE_MUTATION' WHEN role = 'user' AND commitment <> 'COMMITTED' THEN 'QUARANTINE' ELSE 'NEW_MEMORY' END AS main FROM weighed),
 every AS (SELECT *, main AS kind, CASE WHEN aside <> '' THEN aside WHEN main = 'QUARANTINE' THEN 'USER_NOT_DECISION' ELSE '' END AS reason FROM sorted
  UNION ALL SELECT *, 'QUARANTINE', 'LIFECYCLE_TARGET_UNKNOWN' FROM sorted WHERE aside = '' AND corrects AND decides)"""


def _candidates(spark, sf_dir):
    return tasks.candidates(derived(views.evidence(spark, sf_dir).withColumn("content", F.expr(REMARK)), SPEAKING))


@query(f"""{_CANDIDATES} SELECT 'cand_' || substr(sha256(CAST(session AS VARCHAR) || ':' || CAST(ordinal AS VARCHAR) || '|' || CAST(segment AS VARCHAR) || '|' || kind), 1, 32) AS candidate_id, session, ordinal, CAST(segment AS INTEGER) AS segment, kind, reason, commitment,
 CASE WHEN kind = 'QUARANTINE' THEN 0e0 ELSE weight END AS confidence, CASE WHEN kind = 'NEW_MEMORY' THEN {_KIND} END AS memory_type, CASE WHEN kind = 'STATE_MUTATION' THEN state END AS operation, CASE WHEN confirmed THEN approver END AS approver, content FROM every""")
def extracted_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"{_CANDIDATES} SELECT kind, reason, count(*) AS n FROM every GROUP BY kind, reason")
def extraction_counts(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("kind", "reason").agg(F.count("*").alias("n"))


# --- Reports ------------------------------------------------------------------------------------------------------------------------
_LATER = f"least(greatest(expires_s, {AS_OF}) + {7 * DAY}, created_s + {30 * DAY})"


@query(f"{S}, {sql_view('kept', KEEPING, 'statements')} SELECT memory_id, review_status = 'PENDING' AND expires_s <= {AS_OF} AS expired, CASE WHEN review_status = 'PENDING' AND {_LATER} > expires_s THEN {_LATER} END AS extended_s FROM kept")
def review_retention(spark, sf_dir):
    kept = derived(views.statements(spark, sf_dir), KEEPING).select("memory_id", F.col("review_status").alias("status"), "created_s", "expires_s")
    return reports.retention(kept, AS_OF).select("memory_id", "expired", "extended_s")


_SHOTS = f"{L}, shots AS (SELECT at_s // {DAY} * {DAY} AS day_s, count(*) FILTER (action = 'ENQUEUED') - count(*) FILTER (action = 'COMMITTED') AS missing, round(CAST(count(*) FILTER (action = 'COMMITTED') AS DOUBLE) / count(*), 6) AS score FROM ledger GROUP BY 1), recent AS (SELECT * FROM shots WHERE day_s >= {AS_OF - 7 * DAY})"


@query(f"""{_SHOTS} SELECT count(*) AS snapshots, min(day_s) AS first_s, max(day_s) AS last_s, arg_max(score, day_s) < max(score) AS score_fell, arg_max(missing, day_s) AS last_missing, arg_min(missing, day_s) AS first_missing, count(*) >= 2 AND arg_max(missing, day_s) > arg_min(missing, day_s) AS missing_grew FROM recent""")
def measurement_trend(spark, sf_dir):
    day = (F.floor(F.col("at_s") / DAY) * DAY).alias("at_s")
    done = F.count_if(F.col("action") == "COMMITTED")
    shots = views.ledger(spark, sf_dir).groupBy(day).agg((F.count_if(F.col("action") == "ENQUEUED") - done).alias("missing"), F.round(done / F.count("*"), 6).alias("score"))
    return reports.measurement_trend(shots, AS_OF).select("snapshots", "first_s", "last_s", "score_fell", "last_missing", "first_missing", "missing_grew")


@query(f"""{S}, pool AS (SELECT memory_id, store_ordinal, project_id FROM statements WHERE status = 'active' AND type IN ('decision', 'lesson') AND project_id NOT IN ('', '{PROJECT}', 'p_fr') AND is_approved ORDER BY at_s DESC, store_ordinal LIMIT 500)
SELECT memory_id, project_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS similarity FROM pool JOIN embeddings ON store_ordinal = vec_id ORDER BY similarity DESC, store_ordinal LIMIT 3""")
def cross_project_refs(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id = 0").first()
    return reports.other_projects(views.statements(spark, sf_dir), vectors, list(asked["embedding"]) if asked else [], PROJECT, ["p_fr"])


_DISTINCT_WORDS = r"list_filter(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}_][\p{L}\p{N}_-]{3,}')), lambda w: NOT list_contains(" + "[" + ", ".join(map(quoted, reports.COMMON)) + "], w))"


@query(f"""{views.with_views("deliveries", "statements", "evidence")}, asked AS (SELECT DISTINCT session, memory_id FROM deliveries),
 words AS (SELECT memory_id, {_DISTINCT_WORDS} AS words FROM statements WHERE memory_id IN (SELECT memory_id FROM asked)),
 replies AS (SELECT session, list_distinct(flatten(list({_DISTINCT_WORDS}))) AS words FROM evidence WHERE role = 'assistant' GROUP BY session)
SELECT session, memory_id FROM asked JOIN words USING (memory_id) JOIN replies USING (session) WHERE len(words.words) >= 3 AND 2 * len(list_intersect(words.words, replies.words)) >= len(words.words)""")
def used_records(spark, sf_dir):
    return reports.used_records(views.deliveries(spark, sf_dir), views.statements(spark, sf_dir), views.evidence(spark, sf_dir))


_LIMIT, _HEAD = 400, "substr(content, 1, %d)" % (400 - len(reports.CUT_MARK))


@query(f"""{M} SELECT memory_id, CASE WHEN length(content) <= {_LIMIT} THEN content ELSE CASE WHEN regexp_extract({_HEAD}, '(?s)^(.*)\\n', 1) <> '' THEN regexp_extract({_HEAD}, '(?s)^(.*)\\n', 1) ELSE {_HEAD} END || chr(10) || '{reports.CUT_MARK.strip()}' END AS fitted,
 CASE WHEN length(shown) <= 80 THEN shown ELSE substr(shown, 1, 80) || '...' END AS shown FROM (SELECT memory_id, content, regexp_replace(replace(content, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS shown FROM memories)""")
def fitted_contexts(spark, sf_dir):
    c = F.col("content")
    return views.memories(spark, sf_dir).select("memory_id", reports.fitted(c, _LIMIT).alias("fitted"), reports.display_form(c).alias("shown"))


@query(f"""{M}, {sql_view("dated", DATED, "memories")} SELECT memory_id, CASE WHEN regexp_matches(string_split(source_id, ':')[2], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN string_split(source_id, ':')[2] ELSE strftime(DATE '1970-01-01' + CAST(at_s // {DAY} AS INTEGER), '%Y-%m-%d') END AS day FROM dated""")
def record_dates(spark, sf_dir):
    return derived(views.memories(spark, sf_dir), DATED).select("memory_id", reports.record_date(F.col("source_id"), F.col("at_s")).alias("day"))


@query(f"""{views.with_views("candidates")}, modes AS (SELECT unnest(['OFF', 'SHADOW', 'CANARY', 'ACTIVE']) AS mode), gates AS (SELECT mode, on_ AS shadow_accept FROM modes, (SELECT unnest([true, false]) AS on_))
SELECT mode, shadow_accept, count(*) FILTER (mode IN ('CANARY', 'ACTIVE') OR (mode = 'SHADOW' AND approved AND shadow_accept)) AS allowed, count(*) AS effects FROM candidates, gates GROUP BY mode, shadow_accept""")
def accept_gate(spark, sf_dir):
    gates = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(on).alias("shadow_accept")) for m in reports.MODES for on in (True, False)])
    kinds = views.candidates(spark, sf_dir).groupBy("approved").agg(F.count("*").alias("n"))
    each = kinds.select("approved", "n", F.explode(gates).alias("gate")).select("gate.*", "approved", "n")
    allowed = F.when(reports.accept_allowed(F.col("mode"), F.col("shadow_accept"), F.col("approved")), F.col("n")).otherwise(0)
    return each.groupBy("mode", "shadow_accept").agg(F.sum(allowed).alias("allowed"), F.sum("n").alias("effects"))


@query(f"{L} SELECT session, ordinal, action FROM ledger QUALIFY row_number() OVER (PARTITION BY session ORDER BY at_s DESC, ordinal DESC) <= 5")
def audit_tail(spark, sf_dir):
    return reports.last_events(views.ledger(spark, sf_dir), "session", 5).select("session", "ordinal", "action")


@query(f"{D}, built AS (SELECT session, max(at_s) AS revision, CASE session % 3 WHEN 0 THEN max(at_s) WHEN 1 THEN min(at_s) END AS source FROM deliveries GROUP BY session) SELECT session, CASE WHEN source IS NULL THEN 'missing' WHEN source = revision THEN 'fresh' ELSE 'stale' END AS state FROM built")
def projection_status(spark, sf_dir):
    built = views.deliveries(spark, sf_dir).groupBy("session").agg(F.max("at_s").alias("revision"), F.min("at_s").alias("first"))
    source = F.when(F.col("session") % 3 == 0, F.col("revision")).when(F.col("session") % 3 == 1, F.col("first"))
    return built.select("session", reports.projection_state(source, F.col("revision")).alias("state"))


@query(rf"""{M} SELECT memory_id, sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS content_key,
 'fp_' || sha256('{{"candidate_type": "NEW_MEMORY", "content": ' || CAST(to_json(content) AS VARCHAR) || ', "memory_type": ' || CAST(to_json(type) AS VARCHAR) || ', "operation": null, "project_id": ' || CAST(to_json(project_id) AS VARCHAR) || ', "scope": ' || CAST(to_json(scope) AS VARCHAR) || '}}') AS fingerprint FROM memories""")
def review_fingerprints(spark, sf_dir):
    fields = {"candidate_type": F.lit("NEW_MEMORY"), "content": F.col("content"), "memory_type": F.col("type"), "operation": F.lit(None).cast("string"), "project_id": F.col("project_id"), "scope": F.col("scope")}
    return views.memories(spark, sf_dir).select("memory_id", reports.content_key(F.col("content")).alias("content_key"), reports.review_fingerprint(fields).alias("fingerprint"))
