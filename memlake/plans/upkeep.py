"""The registered queries of `memlake.operators.upkeep`, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text
from memlake.lineage import cut
from memlake.operators import upkeep
from memlake.sources import views
from memlake.sources.views import AS_OF

from .queries import _BEST, _SHAPE, FINGERPRINT, NORMAL, QUESTIONS, D, E, L, M, S, _best_similar, _holds, commitment_sql, query, quoted, reason_sql, rlike

DAY = 86400
#: What the tables lack is derived from the place in the store, alike in Spark and in SQL.
LEGACY = {
    "raw_scope": "CASE store_ordinal % 5 WHEN 0 THEN '' WHEN 1 THEN 'team' ELSE scope END",
    "label": "CASE store_ordinal % 3 WHEN 0 THEN concat('Shop ', type) ELSE '' END",
    "raw_project_id": "CASE store_ordinal % 2 WHEN 0 THEN project_id ELSE '' END",
}
REVIEW = {
    "reason": "CASE store_ordinal % 3 WHEN 0 THEN 'LOW_EVIDENCE_COMMITMENT' WHEN 1 THEN 'LIFECYCLE_TARGET_UNKNOWN' ELSE 'BACKFILL' END",
    "review_status": "CASE store_ordinal % 4 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END",
    "candidate_id": "concat('cand_', CAST(store_ordinal AS STRING))",
    "is_state": "store_ordinal % 5 = 0",
}
SOURCE = {"source": "CASE store_ordinal % 3 WHEN 0 THEN 'remember' WHEN 1 THEN 'worker' ELSE 'import' END", "source_id": "concat('truth:cand_', CAST(store_ordinal AS STRING))"}
TOPIC = {"topic": "CASE store_ordinal % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'cache' WHEN 2 THEN 'release' WHEN 3 THEN '' END"}
CLAIM = {"claim_key": "CASE WHEN store_ordinal % 6 = 0 THEN concat('db.key', CAST(store_ordinal % 40 AS STRING)) ELSE '' END"}
RAW_KEY = {"raw_key": "CASE store_ordinal % 5 WHEN 0 THEN concat(' Db.Key-', CAST(store_ordinal AS STRING)) WHEN 1 THEN 'bad key' WHEN 2 THEN '' WHEN 3 THEN concat('a:', repeat('x', 90)) END"}


def derived(df, columns: dict[str, str]):
    return df.withColumns({c: F.expr(x) for c, x in columns.items()})


def sql_view(name: str, columns: dict[str, str], of: str) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f"{x.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, x in columns.items()) + f" FROM {of})"


def _items(spark, sf_dir):
    s = views.statements(spark, sf_dir)
    return derived(s, REVIEW).withColumn("commitment", text.commitment(F.col("content"), F.lit("user")))


ITEMS = f"{S}, {sql_view('reviewed', REVIEW, 'statements')}, items AS (SELECT *, {commitment_sql('lower(content)', quoted('user'))} AS commitment FROM reviewed)"
_SCOPE = "CASE WHEN raw_scope IN ('global', 'project') THEN raw_scope WHEN trim(label) <> '' OR trim(raw_project_id) <> '' THEN 'project' ELSE 'global' END"
_SCOPED = f"""{M}, {sql_view('legacy', LEGACY, 'memories')}, named AS (SELECT * EXCLUDE (scope, project_id), {_SCOPE} AS scope FROM legacy),
 own AS (SELECT *, CASE WHEN scope = 'global' THEN '' ELSE trim(label) END AS project, CASE WHEN scope = 'global' THEN '' WHEN trim(raw_project_id) = '' AND trim(label) <> '' THEN 'legacy-' || substr(sha256(lower(trim(label))), 1, 16) ELSE trim(raw_project_id) END AS project_id FROM named)"""


@query(f"{_SCOPED} SELECT memory_id, scope, project, project_id FROM own")
def infer_scope(spark, sf_dir):
    return upkeep.inferred_scope(derived(views.memories(spark, sf_dir), LEGACY)).select("memory_id", "scope", "project", "project_id")


@query(f"{_SCOPED} SELECT memory_id, scope, project_id, {FINGERPRINT} AS fingerprint, raw_scope <> scope OR raw_project_id <> project_id AS changed FROM own")
def scope_migration(spark, sf_dir):
    return upkeep.migrated(derived(views.memories(spark, sf_dir), LEGACY))


_UNTYPED = FINGERPRINT.replace("|| type ||", "||")
_BARE = f"substr(sha256({NORMAL % 'content'}), 1, 16)"
_KEYS = f"list_filter([{FINGERPRINT}, {_UNTYPED}, CASE WHEN scope = 'global' THEN {_BARE} END], lambda k: k IS NOT NULL)"


@query(f"{M} SELECT memory_id, array_to_string({_KEYS}, ',') AS aliases FROM memories")
def fingerprint_aliases(spark, sf_dir):
    m = views.memories(spark, sf_dir)
    return m.select("memory_id", F.array_join(upkeep.fingerprint_aliases(F.col("scope"), F.col("project_id"), F.col("type"), F.col("content")), ",").alias("aliases"))


@query(f"""{views.with_views('statements', 'candidates')}, stored AS (SELECT memory_id, at_s, unnest({_KEYS}) AS key FROM statements WHERE status <> 'superseded'),
 firsts AS (SELECT key, memory_id FROM stored QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_s, memory_id) = 1), asked AS (SELECT candidate_id, unnest({_KEYS}) AS key, generate_subscripts({_KEYS}, 1) AS place FROM candidates),
 taken AS (SELECT candidate_id, memory_id FROM asked JOIN firsts USING (key) QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY place) = 1)
SELECT coalesce(t.memory_id, '') AS memory_id, c.candidate_id, CASE WHEN t.memory_id IS NULL THEN 'new' ELSE 'matched' END AS origin FROM candidates c LEFT JOIN taken t USING (candidate_id)
UNION ALL SELECT memory_id, '', 'kept' FROM statements WHERE memory_id NOT IN (SELECT memory_id FROM taken)""")
def merge_with_prior(spark, sf_dir):
    return upkeep.merged_with_prior(views.candidates(spark, sf_dir), views.statements(spark, sf_dir))


@query(f"{M}, {sql_view('claims', CLAIM, 'memories')} SELECT x.store_ordinal AS id, min(y.store_ordinal) AS holder FROM claims x JOIN claims y USING (scope, project_id, claim_key) WHERE x.claim_key <> '' AND y.status = 'active' AND x.store_ordinal <> y.store_ordinal GROUP BY 1")
def claim_holder(spark, sf_dir):
    return upkeep.claim_holders(derived(views.memories(spark, sf_dir), CLAIM).withColumn("id", F.col("store_ordinal")))


@query(f"{M}, {sql_view('keyed', RAW_KEY, 'memories')} SELECT memory_id, CASE WHEN trim(coalesce(raw_key, '')) = '' THEN '' WHEN length(trim(raw_key)) <= 80 AND {rlike('lower(trim(raw_key))', upkeep.CLAIM_KEY)} THEN lower(trim(raw_key)) END AS claim_key FROM keyed")
def claim_key_normalize(spark, sf_dir):
    return derived(views.memories(spark, sf_dir), RAW_KEY).select("memory_id", upkeep.claim_key(F.col("raw_key")).alias("claim_key"))


@query(f"""{M}, refs AS (SELECT DISTINCT 'p_' || ['en', 'fr', 'de', 'es'][CAST(user_id % 4 AS INTEGER) + 1] AS project, 'mem_' || lpad(CAST(event_id % 1500 AS VARCHAR), 8, '0') AS memory_id FROM events)
SELECT project, memory_id, CASE WHEN m.status IS NULL OR m.status NOT IN ('active', 'resolved', 'superseded') THEN 'dangling' WHEN m.scope = 'global' OR m.project_id = project THEN 'valid' ELSE 'wrong_project' END AS health FROM refs LEFT JOIN memories m USING (memory_id)""")
def reference_health(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    refs = e.select(F.concat(F.lit("p_"), views.pick(("en", "fr", "de", "es"), F.col("user_id") % 4)).alias("project"), views.memory_id(F.col("event_id") % 1500).alias("memory_id"))
    return upkeep.reference_health(refs, views.memories(spark, sf_dir))


@query(f"""{S}, {sql_view('sourced', {**SOURCE, **REVIEW}, 'statements')}, accepted AS (SELECT candidate_id, max(reason) AS why FROM sourced WHERE review_status = 'ACCEPTED' GROUP BY 1)
SELECT CASE WHEN source = 'remember' THEN 'remember' WHEN source <> 'worker' THEN 'other' WHEN why = 'BACKFILL' THEN 'backfill_accepted' WHEN why IS NOT NULL THEN 'captured_accepted' ELSE 'captured_direct' END AS kind, count(*) AS n
FROM sourced s LEFT JOIN accepted a ON a.candidate_id = regexp_replace(s.source_id, '^truth:', '') WHERE status = 'active' GROUP BY 1""")
def provenance_split(spark, sf_dir):
    s = derived(views.statements(spark, sf_dir), {**SOURCE, **REVIEW})
    return upkeep.provenance_split(s.select("status", "source", "source_id"), s.where("review_status = 'ACCEPTED'").select("candidate_id", "reason"))


#: Texts that name files in every way the pattern tells apart, before the statements' own words.
NAMES = ("", "see /etc/app.py and https://x.org/a.py", "notlar/özet.md, then ./docs/plan.md.", "src/app.py2 but a-b/c_d.test.js", "(docs/plan.md)", "x..md .md ../up.txt", "önce src/app.py")
_NAMES = "[" + ", ".join(map(quoted, NAMES)) + "]"
_NAMING = f"{S}, naming AS (SELECT * REPLACE ({_NAMES}[CAST(store_ordinal % {len(NAMES)} AS INTEGER) + 1] || ' ' || content AS content) FROM statements)"
# RE2 has no look-behind: names are taken with the character before them, which must not be one of a name, where they begin
_PATHS = r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(content, '[\p{L}\p{N}_./-]*[\p{L}\p{N}_./-]'), lambda p: NOT starts_with(p, '/') AND regexp_matches(p, '^(?:[\p{L}\p{N}_.-]+/)*[\p{L}\p{N}_.-]+\.(?:py|md|json|jsonl|toml|js|ts|tsx|css|html|yml|yaml|sh|ps1|txt|cfg|ini)(?:[./-]|$)')), lambda p: trim(regexp_extract(p, '^((?:[\p{L}\p{N}_.-]+/)*[\p{L}\p{N}_.-]+\.(?:py|md|json|jsonl|toml|js|ts|tsx|css|html|yml|yaml|sh|ps1|txt|cfg|ini))(?:[./-]|$)', 1), './'))))"


def _naming(spark, sf_dir):
    s = views.statements(spark, sf_dir)
    return s.withColumn("content", F.concat(views.pick(NAMES, F.col("store_ordinal") % len(NAMES)), F.lit(" "), F.col("content")))


@query(f"{_NAMING} SELECT memory_id, array_to_string({_PATHS}, ',') AS paths FROM naming WHERE len({_PATHS}) > 0")
def referenced_paths(spark, sf_dir):
    return _naming(spark, sf_dir).select("memory_id", F.array_join(upkeep.referenced_paths(F.col("content")), ",").alias("paths")).where("paths != ''")


_CHANGED = AS_OF - 20 * DAY


@query(f"""{views.with_views('statements', 'projects')}, naming AS {_NAMING.split(', naming AS ')[1]}, files AS (SELECT project_id, 'docs/plan.md' AS path, CAST({_CHANGED} AS BIGINT) AS changed_s FROM projects UNION ALL SELECT project_id, 'src/app.py', NULL FROM projects),
 named AS (SELECT memory_id, store_ordinal, project_id, at_s, unnest({_PATHS}) AS path FROM naming WHERE status = 'active')
SELECT memory_id, path, CASE WHEN changed_s IS NULL THEN 'SOURCE_MISSING' ELSE 'SOURCE_CHANGED' END AS reason FROM named JOIN files USING (project_id, path) WHERE (changed_s IS NULL OR changed_s > at_s) AND NOT (changed_s IS NOT NULL AND store_ordinal % 32 = 13)""")
def staleness_scan(spark, sf_dir):
    projects, s = views.projects(spark, sf_dir), _naming(spark, sf_dir)
    files = projects.select("project_id", F.lit("docs/plan.md").alias("path"), F.lit(_CHANGED).cast("long").alias("changed_s")).union(projects.select("project_id", F.lit("src/app.py"), F.lit(None).cast("long")))
    acknowledged = s.where("store_ordinal % 32 = 13").select("memory_id", F.lit("docs/plan.md").alias("path"), F.lit(_CHANGED).cast("long").alias("changed_s"))
    return upkeep.stale_records(s, files, acknowledged)


_FOLDER = "CASE WHEN doc_id % 10 = 0 THEN concat('/tmp/', source) ELSE concat('/work/', lang, '/', source, '/notes') END"


@query(f"""{views.with_views('projects')}, roots AS (SELECT root FROM projects UNION SELECT '/work/en/src0'), paths AS (SELECT DISTINCT {_FOLDER} AS path FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT path, coalesce(arg_max(root, length(root)), '') AS root FROM paths LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path""")
def resolve_containing(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    roots = views.projects(spark, sf_dir).select("root").union(spark.range(1).select(F.lit("/work/en/src0")))
    return upkeep.containing_roots(docs.select(F.expr(_FOLDER).alias("path")), roots)


@query(f"{D} SELECT session, min(at_s) AS first_s, max(at_s) AS last_s FROM deliveries GROUP BY session HAVING min(at_s) < {AS_OF - 10 * DAY} AND max(at_s) >= {AS_OF - 17 * DAY}")
def recap_window(spark, sf_dir):
    spans = views.deliveries(spark, sf_dir).groupBy("session").agg(F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"))
    return upkeep.overlapping(spans, AS_OF - 17 * DAY, AS_OF - 10 * DAY)


_NOISE = f"""CASE WHEN commitment = 'COMMITTED' AND type = 'decision' THEN '' WHEN commitment = 'QUOTED' THEN 'QUOTED' WHEN shape = 'short_ack' THEN 'SHORT_ACK' WHEN reason = 'LOW_EVIDENCE_COMMITMENT' AND shape = 'prose' THEN 'LOW_EVIDENCE_PROSE'
 WHEN reason = 'LOW_EVIDENCE_COMMITMENT' AND shape = 'terminal_or_code' THEN 'LOW_EVIDENCE_CODE' WHEN reason = 'LIFECYCLE_TARGET_UNKNOWN' AND commitment = 'OBSERVED' THEN 'OBSERVED_UNKNOWN_TARGET' ELSE '' END"""
_RULED = f"{ITEMS}, ruled AS (SELECT memory_id, {_NOISE} AS rule FROM (SELECT *, {_SHAPE} AS shape FROM items))"


def _ruled(spark, sf_dir):
    return _items(spark, sf_dir).select("memory_id", upkeep.noise_rule(F.col("reason"), F.col("commitment"), F.col("type"), F.col("content")).alias("rule"))


@query(f"{_RULED} SELECT memory_id, rule FROM ruled")
def noise_rules(spark, sf_dir):
    return _ruled(spark, sf_dir)


@query(f"{_RULED} SELECT rule, count(*) AS n FROM ruled WHERE rule <> '' GROUP BY rule")
def triage_counts(spark, sf_dir):
    # cut, else the filter would judge every text a second time
    return cut(_ruled(spark, sf_dir).select("rule")).where("rule != ''").groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""{ITEMS}, {_BEST} SELECT memory_id, CASE WHEN {rlike('trim(content)', text.PASTED_OUTPUT)} THEN 'PASTED_OUTPUT' WHEN {rlike('trim(content)', upkeep.MACHINE)} THEN 'MACHINE_CONTENT' WHEN length(trim(content)) > 600 THEN 'TOO_LONG' WHEN length(trim(content)) < 20 THEN 'TOO_SHORT' WHEN commitment = 'QUESTION' THEN 'QUESTION'
 WHEN is_state AND commitment <> 'COMMITTED' THEN 'STATE_NOT_COMMITTED' WHEN b.similarity >= 0.6 THEN 'DUPLICATE' ELSE '' END AS verdict FROM items LEFT JOIN best b ON b.id = store_ordinal""")
def rule_verdicts(spark, sf_dir):
    # the duplicate rule is the last, so texts are judged by the others first, once, and the rule asks for those that they leave; below 0.6 nothing counts
    # (the commitment is no column, so that it is read off those texts only that the rules before it leave)
    others = upkeep.rule_verdict(F.col("content"), text.commitment(F.col("content"), F.lit("user")), F.col("is_state"), F.lit(0.0))
    judged = cut(derived(views.statements(spark, sf_dir), REVIEW).select("memory_id", "store_ordinal", others.alias("verdict")))
    left = judged.where("verdict = ''").select(F.col("store_ordinal").alias("id"))
    met = judged.join(_best_similar(spark, sf_dir, left, 0.594), F.col("store_ordinal") == F.col("id"), "left")
    return met.select("memory_id", F.when((F.col("verdict") == "") & (F.col("similarity") >= 0.6), "DUPLICATE").otherwise(F.col("verdict")).alias("verdict"))


@query(f"{S}, {_BEST} SELECT id, similarity FROM best")
def digest_similarity(spark, sf_dir):
    return _best_similar(spark, sf_dir)


@query(f"{ITEMS} SELECT reason, review_status, count(*) AS n FROM items WHERE at_s >= {AS_OF - 14 * DAY} GROUP BY reason, review_status")
def review_since(spark, sf_dir):
    return _items(spark, sf_dir).where(F.col("at_s") >= AS_OF - 14 * DAY).groupBy("reason", "review_status").agg(F.count("*").alias("n"))


@query(f"{M} SELECT memory_id, code FROM (SELECT memory_id, CASE WHEN {reason_sql('content')} <> '' THEN 'UNSAFE_' || upper({reason_sql('content')}) WHEN length(content) > 8000 THEN 'UNSAFE_PAYLOAD_TOO_LARGE' ELSE '' END AS code FROM memories) WHERE code <> ''")
def review_refusals(spark, sf_dir):
    return views.memories(spark, sf_dir).select("memory_id", upkeep.refusal(F.col("content")).alias("code")).where("code != ''")


@query(f"{M} SELECT memory_id FROM memories WHERE is_approved AND {reason_sql('content')} = ''")
def agent_readable(spark, sf_dir):
    return views.memories(spark, sf_dir).where(upkeep.agent_readable(F.col("is_approved"), F.col("content"), True)).select("memory_id")


_LINES = "list_filter(string_split(content, chr(10)), lambda y: trim(y) <> '')"


@query(f"{M} SELECT memory_id FROM memories WHERE length(content) >= 1500 AND (len({_LINES}) >= 25 OR len(list_filter({_LINES}, lambda y: {rlike('y', upkeep.HEADING)})) >= 5)")
def pasted_documents(spark, sf_dir):
    return views.memories(spark, sf_dir).where(upkeep.pasted_document(F.col("content"))).select("memory_id")


@query(f"{S} SELECT memory_id FROM statements WHERE status = 'active' AND type = 'observation' AND {AS_OF} - at_s >= {14 * DAY} AND {rlike('lower(content)', upkeep.STATUS_NOTE)}")
def stale_status_notes(spark, sf_dir):
    return upkeep.stale_status_notes(views.statements(spark, sf_dir), AS_OF)


@query(f"{views.with_views('memories', 'deliveries')}, {sql_view('sourced', SOURCE, 'memories')} SELECT memory_id FROM sourced WHERE status = 'active' AND source = 'worker' AND {AS_OF} - at_s >= 0 AND {AS_OF} - at_s < {14 * DAY} AND memory_id NOT IN (SELECT memory_id FROM deliveries WHERE kind = 'purchase')")
def on_probation(spark, sf_dir):
    accepted = views.deliveries(spark, sf_dir).where("kind = 'purchase'")
    return upkeep.on_probation(derived(views.memories(spark, sf_dir), SOURCE), accepted, AS_OF)


@query(f"{E} SELECT session, ordinal, before FROM (SELECT session, ordinal, role, lag(ordinal) OVER (PARTITION BY session ORDER BY ordinal) AS before FROM evidence) WHERE role = 'user' AND before IS NOT NULL")
def previous_message(spark, sf_dir):
    return upkeep.previous_messages(views.evidence(spark, sf_dir))


@query(f"{L} SELECT session, ordinal, at_s, action FROM ledger QUALIFY row_number() OVER (PARTITION BY session ORDER BY at_s DESC, ordinal DESC) = 1")
def latest_receipts(spark, sf_dir):
    return upkeep.latest_receipts(views.ledger(spark, sf_dir))


@query(f"""{E}, cards AS (SELECT session % 5 AS project, session, max(ordinal) AS updated, sum(length(content)) AS size FROM evidence GROUP BY session)
SELECT project, session FROM (SELECT *, sum(size) OVER w AS used, row_number() OVER w AS place FROM cards WINDOW w AS (PARTITION BY project ORDER BY updated DESC, session ROWS UNBOUNDED PRECEDING)) WHERE place = 1 OR used <= 3000""")
def card_selection(spark, sf_dir):
    cards = views.evidence(spark, sf_dir).groupBy("session").agg(F.max("ordinal").alias("updated"), F.sum(F.length("content")).alias("size"))
    return upkeep.kept_cards(cards.withColumn("project", F.col("session") % 5))


@query("""WITH disk AS (SELECT vec_id AS key, label AS value FROM embeddings), own AS (SELECT vec_id + 100 AS key, label + CAST(vec_id % 3 AS INTEGER) - 1 AS value FROM embeddings)
SELECT key, least(d.value, o.value) AS value, CASE WHEN o.key IS NULL THEN 'disk' WHEN d.key IS NULL THEN 'own' ELSE 'both' END AS origin FROM disk d FULL JOIN own o USING (key)""")
def embedding_cache_merge(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    own = e.select((F.col("vec_id") + 100).alias("key"), (F.col("label") + (F.col("vec_id") % 3).cast("int") - 1).alias("value"))
    return upkeep.merged_caches(e.select(F.col("vec_id").alias("key"), F.col("label").alias("value")), own)


@query(f"""{views.with_views('memories', 'evidence')}, refs AS (SELECT memory_id, unnest([store_ordinal % 120, store_ordinal % 7 + 80]) AS session FROM memories WHERE store_ordinal % 3 <> 0 UNION ALL SELECT memory_id, NULL FROM memories WHERE store_ordinal % 3 = 0),
 there AS (SELECT session, count(*) FILTER (role = 'user') AS asked FROM evidence GROUP BY session)
SELECT memory_id, coalesce(session, -1) AS session, CASE WHEN r.session IS NULL THEN 'no_reference' WHEN asked IS NULL THEN 'missing' WHEN asked = 0 THEN 'no_user_turn' ELSE 'found' END AS status FROM refs r LEFT JOIN there USING (session)""")
def evidence_trail(spark, sf_dir):
    refs = F.when(F.col("store_ordinal") % 3 != 0, F.array(F.col("store_ordinal") % 120, F.col("store_ordinal") % 7 + 80))
    return upkeep.evidence_trail(views.memories(spark, sf_dir).withColumn("refs", refs), views.evidence(spark, sf_dir))


@query(f"{S} " + " UNION ALL ".join(f"SELECT {quoted(q)} AS question, project_id, min(memory_id) AS memory_id FROM statements WHERE {_holds(g)} GROUP BY project_id HAVING count(*) = 1" for q, g in QUESTIONS))
def sole_carriers(spark, sf_dir):
    low = F.lower("content")

    def every(groups):
        out = F.lit(True)
        for group in groups:
            one = F.lit(False)
            for term in group:
                one = one | low.contains(term)
            out = out & one
        return out

    return upkeep.sole_carriers(views.statements(spark, sf_dir), {q: every(g) for q, g in QUESTIONS})


@query(f"{M}, {sql_view('themed', TOPIC, 'memories')} SELECT project_id, coalesce(topic, '') AS topic, count(*) AS n FROM themed WHERE status = 'active' GROUP BY 1, 2")
def topics(spark, sf_dir):
    return upkeep.topic_counts(derived(views.memories(spark, sf_dir), TOPIC))


@query(f"{M} SELECT type, count(*) AS considered, min(at_s // 86400) AS first_day, max(at_s // 86400) AS last_day FROM memories WHERE at_s >= {AS_OF - 30 * DAY} GROUP BY type")
def digest_envelope(spark, sf_dir):
    return upkeep.digest_envelope(views.memories(spark, sf_dir), AS_OF - 30 * DAY)
