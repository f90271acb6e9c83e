"""Requests and turns: what a request asks for, which records serve it, and the candidates that turns give rise to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.functions.text import any_word, capture_reason, normalized

from .upkeep import pasted_document

#: Phrases that tell the intent, the domains, the constraints and the risks of a request. The first intent counts.
INTENTS = {
    "PLAN": ("planla", "planını", "planini", "plan yap", "roadmap", "yol haritası", "plan"),
    "REVIEW": ("code review", "review", "inspect", "incele", "gözden geçir", "audit", "denetle"),
    "DEBUG": ("debug", "bug", "hata", "fix", "düzelt", "arıza"),
    "MIGRATE": ("migrate", "migration", "migrasyon", "göç"),
    "TEST": ("test et", "test", "doğrula", "validate"),
    "RESEARCH": ("araştır", "research", "investigate", "keşfet"),
    "EXPLAIN": ("açıkla", "explain", "nasıl çalış"),
    "DESIGN": ("tasarla", "design", "mimari", "architecture"),
    "OPERATE": ("deploy", "çalıştır", "operate", "izle", "monitor", "release"),
    "IMPLEMENT": ("uygula", "implement", "ekle", "oluştur", "build", "yap"),
}
DOMAINS = {
    "context-engine": ("context engine", "context", "bağlam", "router", "retrieval"),
    "task-model": ("task model", "task", "görev"),
    "state-management": ("state", "project state", "durum"),
    "memory": ("memory", "hafıza", "validated-memory", "memory store"),
    "project-identity": ("project registry", "project identity", "proje kaydı"),
    "session-runtime": ("sessionstart", "sessionend", "bootstrap", "hook", "oturum"),
    "evaluation": ("evaluation", "eval", "benchmark", "golden corpus"),
    "recovery": ("backup", "restore", "recovery", "yedek", "geri yükle"),
    "security": ("security", "secret", "token", "api key", "güvenlik", "parola"),
    "persistence": ("sqlite", "json", "store", "migration", "migrasyon", "göç"),
}
CONSTRAINTS = {
    "no_production_changes": ("production code'a dokunma", "production code dokunma", "production değiştir", "productiona dokunma"),
    "no_router": ("router yapma", "router ekleme", "no router"),
    "no_llm": ("llm kullanma", "model kullanma", "no llm"),
    "offline_only": ("internet kullanma", "network kullanma", "offline"),
    "no_commit_or_push": ("commit yapma", "push yapma", "no commit", "no push"),
}
RISKS = {
    "data_loss": ("rm -rf", "hard reset", "veri kaybı", "data loss"),
    "destructive_change": ("sil", "silme", "silmeyi", "delete", "drop", "overwrite", "üzerine yaz"),
    "migration": ("migration", "migrasyon", "göç", "schema"),
    "security": ("auth", "secret", "token", "api key", "password", "parola"),
    "canonical_store": ("validated-memory", "memory store", "canonical memory", "canonical store"),
    "architecture_change": ("architecture", "mimari", "contract", "sözleşme", "tasarla", "design"),
    "cross_project": ("cross-project", "başka proje", "other project", "projects"),
    "external_dependency": ("network", "internet", "external", "deploy", "deployment", "docker"),
}
#: The operation and the output of each intent, the needs it has, and the intents that task-aware selection knows.
OPERATION = {"PLAN": "design", "DESIGN": "design", "REVIEW": "inspect", "RESEARCH": "inspect", "EXPLAIN": "inspect", "DEBUG": "modify", "IMPLEMENT": "modify", "MIGRATE": "modify", "TEST": "test", "OPERATE": "operate", "UNKNOWN": "unknown"}
OUTPUT = {"PLAN": "implementation_plan", "DESIGN": "design_spec", "REVIEW": "review_report", "RESEARCH": "research_notes", "EXPLAIN": "explanation", "DEBUG": "code_change", "IMPLEMENT": "code_change", "MIGRATE": "code_change", "TEST": "test_result", "OPERATE": "operational_result", "UNKNOWN": "unknown"}
NEEDS = {
    "project_decisions": ("PLAN", "DESIGN", "IMPLEMENT", "DEBUG", "MIGRATE", "REVIEW", "TEST"),
    "active_requirements": ("PLAN", "DESIGN", "IMPLEMENT", "DEBUG", "MIGRATE"),
    "recent_changes": ("REVIEW", "TEST"),
    "relevant_lessons": ("RESEARCH",),
}
PROFILED = ("IMPLEMENT", "MIGRATE", "TEST", "DEBUG", "REVIEW", "PLAN", "DESIGN", "RESEARCH")
#: Chat intents in the order in which they are tried; what none fits is a QUERY.
CHAT_INTENTS = {
    "ANOMALY": r"(anomaly|anomalies|contradiction|risk|alert|duplicate|stale|broken)",
    "SUMMARIZE": r"(summarize|recap|what happened|summary|digest|daily|weekly|monthly)",
    "GRAPH": r"(connected|relationship|depends?\b|graph|who uses|what uses|linked to)",
    "REFLECT": r"(reflect|lessons learned|what did we learn|thoughts on)",
    "CREATE": r"^(remember|note that|remember to)\b",
    "ANALYZE": r"(analyze|deep dive|why did|how did|explain)",
}
#: Where a turn is split, and the fillers of dictation.
SEGMENT_ENDS = r"(?i)(?<=[.!?。！？])\s+|\s*;\s*|\s+(?:ama|fakat|ancak|but|however)\s+"
LEADING_FILLER = r"^(?:(?:[Ee],|[Ee]e+[,.]?|ıı+[,.]?|[Hh]mm+[,.]?)\s+)+"
INNER_FILLER = r"(?<=[\p{L}\p{N}_]) e,(?= )| (?:ee+|ıı+|hmm+)[,.]?(?= )"
#: The confidence that a commitment, a role and the other signals stand for, and why a segment is set aside.
COMMITMENT_SIGNAL = {"COMMITTED": 0.92, "OBSERVED": 0.68, "NEGATED": 0.35, "PROPOSED": 0.20, "HYPOTHETICAL": 0.18, "QUESTION": 0.12, "QUOTED": 0.12, "UNCERTAIN": 0.25}
AUTHORITY = {"user": 1.0, "summary": 0.7, "subagent": 0.5}
SET_ASIDE = {"PROPOSED": "ASSISTANT_PROPOSAL", "HYPOTHETICAL": "HYPOTHETICAL_NOT_COMMITMENT", "QUESTION": "QUESTION_NOT_COMMITMENT", "QUOTED": "QUOTED_CONTENT", "NEGATED": "NEGATED_CLAIM", "UNCERTAIN": "LOW_EVIDENCE_COMMITMENT"}
ENTITIES, SHORTEST, PLACES = 32, 3, 4


def chosen(x: Column, values: dict, otherwise) -> Column:
    """The value that `values` gives for a column."""
    found = F.lit(otherwise)
    for key, value in reversed(values.items()):
        found = F.when(x == key, F.lit(value)).otherwise(found)
    return found


def matching(x: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The names of the rules of which a phrase stands in `x` as whole words, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(x.rlike(any_word(*phrases)), name) for name, phrases in rules.items()]))


def rule_confidence(n: Column, single: float, ambiguous: float) -> Column:
    return F.when(n == 0, 0.0).when(n > 1, ambiguous).otherwise(single)


def request_entities(raw: Column) -> Column:
    """Phases and identifiers that a request names itself, sorted, at most `ENTITIES`."""
    phases = F.transform(F.regexp_extract_all(raw, F.lit(r"(?i)(?<![\p{L}\p{N}_])phase[- ]\d+(?![\p{L}\p{N}_])"), F.lit(0)), lambda p: F.replace(F.lower(p), F.lit(" "), F.lit("-")))
    names = F.regexp_extract_all(raw, F.lit(r"(?<![\p{L}\p{N}_])(?:[A-Z][A-Za-z0-9_]{2,}|[a-z]+_[a-z0-9_]+)(?![\p{L}\p{N}_])"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.concat(phases, F.filter(names, lambda n: F.lower(n) != "phase")))), 1, ENTITIES)


def analyzed(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """`requests` (content, project_id and others) with what they ask for; blank ones are left out.

    Added: project_status, intents, intent, operation, output, domains, constraints, risks, risk_level, confidence, ambiguities, entities,
    needs, need_status, profile. `projects` (project_id, status) has a row per project; an unknown or missing one is unresolved.
    """
    known = projects.select("project_id", F.when(F.col("status") == "archived", "archived").otherwise("resolved").alias("project_status"))
    met = requests.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "").join(known, "project_id", "left").withColumn("project_status", F.coalesce("project_status", F.lit("unresolved")))
    x = normalized(F.col("content"))
    rules = {"intents": INTENTS, "domains": DOMAINS, "constraints": CONSTRAINTS, "risks": RISKS}
    ruled = met.withColumns({name: matching(x, table) for name, table in rules.items()} | {"entities": request_entities(F.col("content"))})
    is_known, n_intents = F.col("project_status") != "unresolved", F.size("intents")
    ruled = ruled.withColumn("intent", F.coalesce(F.get("intents", F.lit(0)), F.lit("UNKNOWN")))
    has = lambda *flags: F.arrays_overlap("risks", F.array(*map(F.lit, flags)))
    level = F.when(has("data_loss") | (has("destructive_change") & has("canonical_store")), "CRITICAL").when(has("destructive_change", "migration", "security", "canonical_store"), "HIGH").when(F.size("risks") > 0, "MEDIUM").otherwise("LOW")
    confidence = F.round((is_known.cast("double") + rule_confidence(n_intents, 0.70, 0.40) + rule_confidence(F.size("domains"), 0.70, 0.45)) / 3, PLACES)
    ambiguities = F.array_compact(F.array(F.when(~is_known, "project"), F.when(n_intents != 1, "intent"), F.when(F.size("domains") == 0, "domain")))
    needs = F.array_sort(F.array_compact(F.array(F.when(is_known, "current_project_state"), *[F.when(F.col("intent").isin(*intents), need) for need, intents in NEEDS.items()])))
    out = ruled.select("*", chosen(F.col("intent"), OPERATION, "unknown").alias("operation"), chosen(F.col("intent"), OUTPUT, "unknown").alias("output"), level.alias("risk_level"), confidence.alias("confidence"), ambiguities.alias("ambiguities"), needs.alias("needs"))
    general = ~F.col("intent").isin(*PROFILED)
    no_need = general & (F.size("entities") == 0) & (F.size("needs") == 0)
    return out.select("*", F.when(no_need, "NO_NEED").otherwise("READY").alias("need_status"), F.when(general, "general").otherwise(F.lower("intent")).alias("profile"))


def chat_intent(content: Column) -> Column:
    x, found = F.lower(content), F.lit("QUERY")
    for name, pattern in reversed(CHAT_INTENTS.items()):
        found = F.when(x.rlike(pattern), name).otherwise(found)
    return found


def recent_turns(turns: DataFrame, most: int = 5) -> DataFrame:
    """The last `most` exchanges, two turns each, of every session."""
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ordinal")))
    return turns.withColumn("place", last).where(F.col("place") <= 2 * most)


def task_order(ranked: DataFrame, asked: list[str]) -> DataFrame:
    """`ranked` (memory_id, type, content, score) with `lexical`, the share of the asked words that a record holds, in the order in which
    task-aware selection looks at records."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    terms = list(dict.fromkeys(asked))
    share = F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) / F.lit(max(1, len(terms)))
    return ranked.withColumn("lexical", share).orderBy(F.desc("lexical"), F.desc("score"), "type", "memory_id", F.sha2("content", 256))


def safety_flags(content: Column) -> Column:
    """question, hypothetical and quoted, as far as they hold for a content."""
    x = F.lower(content)
    return F.array_compact(F.array(
        F.when(x.contains("?") | x.rlike(text.QUESTION), "question"),
        F.when(x.rlike(text.HYPOTHETICAL), "hypothetical"),
        F.when(x.rlike(text.QUOTE) | x.rlike(text.QUOTE_WORD), "quoted"),
    ))


def prefiltered(records: DataFrame) -> DataFrame:
    """`records` (content) with flags, the reason not to pass a content to a model ('' if none), its hash and length."""
    own = records.withColumns({"flags": safety_flags(F.col("content")), "unsafe": capture_reason(F.col("content"))})
    reason = F.when(F.col("unsafe") != "", F.col("unsafe")).when(F.array_contains("flags", "quoted"), "quoted_material").otherwise("")
    return own.select("*", reason.alias("reason"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), F.length("content").alias("content_length"))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def segments(content: Column) -> Column:
    """The sentences of a turn, without empty ones."""
    return F.filter(F.transform(F.split(content, SEGMENT_ENDS), stripped), lambda x: x != "")


def without_fillers(content: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(content, LEADING_FILLER, ""), INNER_FILLER, ""))


def candidates(turns: DataFrame) -> DataFrame:
    """What turns (session, ordinal, role, content, project_id, at_s) give rise to: candidate_id, session, ordinal, segment, kind, reason,
    commitment, confidence, memory_type, operation, approver, content.

    A segment is a NEW_MEMORY, a STATE_MUTATION or set aside as QUARANTINE, with the reason; a correction that is a decision too is both
    set aside and judged on. What an assistant decided and the next turn, a user's, only approves is a decision of the user's, with that
    turn as its approver; the approval itself gives nothing. Summaries and reports of subagents are left to operators of their own. A
    null content is empty and gives nothing; a null project leaves all segments unresolved.
    """
    order = Window.partitionBy("session").orderBy("ordinal")
    own = turns.where(F.col("role").isNull() | ~F.col("role").isin("summary", "subagent")).withColumn("content", F.coalesce("content", F.lit("")))
    beside = turns.select("session", "ordinal", F.lag("role").over(order).alias("role_before"), F.lead("role").over(order).alias("role_after"), F.lead("content").over(order).alias("after"), F.lead("ordinal").over(order).alias("next"))
    approval = (F.col("role") == "user") & (F.col("role_before") == "assistant") & text.affirmation(F.col("content"))
    approver = F.when((F.col("role") == "assistant") & (F.col("role_after") == "user") & text.affirmation(F.col("after")), F.col("next"))
    said = own.join(beside, ["session", "ordinal"]).where(~F.coalesce(approval, F.lit(False)))
    pasted = (F.col("role") == "user") & pasted_document(F.col("content"))
    split = said.select("session", "ordinal", "role", "project_id", "at_s", approver.alias("approver"), F.coalesce(pasted, F.lit(False)).alias("pasted"), F.posexplode(segments(F.col("content"))).alias("segment", "raw"))
    x, low = F.col("content"), F.lower("content")
    judged = split.withColumn("content", without_fillers(F.col("raw"))).where(F.length("content") >= SHORTEST)
    judged = judged.withColumns({"said": text.commitment(x, F.col("role")), "as_user": text.commitment(x, F.lit("user")), "corrects": low.rlike(text.CORRECTION), "decides": low.rlike(text.DECISION)})
    confirmed = F.col("approver").isNotNull() & (F.col("said") == "PROPOSED") & (F.col("as_user") == "COMMITTED")
    judged = judged.withColumn("confirmed", confirmed).withColumn("commitment", F.when(F.col("confirmed"), "COMMITTED").otherwise(F.col("said")))
    told = low.rlike(text.LESSON) | low.rlike(text.PREFERENCE) | low.rlike(text.CURRENT) | low.rlike(text.REQUIREMENT)
    confidence = F.round(
        chosen(F.col("commitment"), COMMITMENT_SIGNAL, 0.25) * 0.30 + F.when(F.col("confirmed"), 1.0).otherwise(chosen(F.col("role"), AUTHORITY, 0.25)) * 0.20
        + F.when(F.col("decides") | told, 0.90).otherwise(0.55) * 0.20 + F.col("project_id").isNotNull().cast("double") * 0.15
        + F.when(F.col("at_s").isNotNull(), 0.80).otherwise(0.55) * 0.10 + F.when(F.col("corrects"), 0.30).otherwise(0.85) * 0.05, PLACES,
    )
    aside = F.when(x.rlike(text.PASTED_OUTPUT), "PASTED_OUTPUT").when(F.col("pasted"), "USER_PASTED_DOCUMENT").when(F.col("unsafe") != "", F.col("unsafe")).when(F.col("project_id").isNull(), "SCOPE_UNRESOLVED").otherwise(chosen(F.col("commitment"), SET_ASIDE, ""))
    judged = judged.withColumns({"weight": confidence, "unsafe": capture_reason(x), "state": text.state_operation(x)}).withColumn("aside", aside)
    kind = F.when(F.col("aside") != "", "QUARANTINE").when(F.col("state").isNotNull(), "STATE_MUTATION").when((F.col("role") == "user") & (F.col("commitment") != "COMMITTED"), "QUARANTINE").otherwise("NEW_MEMORY")
    judged = judged.withColumn("main", kind)
    row = lambda kind, reason: F.struct(kind.alias("kind"), reason.alias("reason"))
    reason = F.when(F.col("aside") != "", F.col("aside")).when(F.col("main") == "QUARANTINE", "USER_NOT_DECISION").otherwise("")
    unknown_target = F.when((F.col("aside") == "") & F.col("corrects") & F.col("decides"), row(F.lit("QUARANTINE"), F.lit("LIFECYCLE_TARGET_UNKNOWN")))
    each = judged.select("*", F.explode(F.array_compact(F.array(row(F.col("main"), reason), unknown_target))).alias("row")).select("*", "row.kind", "row.reason")
    known_by = F.concat_ws("|", F.concat_ws(":", F.col("session").cast("string"), F.col("ordinal").cast("string")), F.col("segment").cast("string"), "kind")
    return each.select(
        F.concat(F.lit("cand_"), F.substring(F.sha2(known_by, 256), 1, 32)).alias("candidate_id"), "session", "ordinal", "segment", "kind", "reason", "commitment",
        F.when(F.col("kind") == "QUARANTINE", 0.0).otherwise(F.col("weight")).alias("confidence"), F.when(F.col("kind") == "NEW_MEMORY", text.memory_kind(x)).alias("memory_type"),
        F.when(F.col("kind") == "STATE_MUTATION", F.col("state")).alias("operation"), F.when(F.col("confirmed"), F.col("approver")).alias("approver"), "content",
    )
