"""Scope, review, provenance, staleness and reporting operators over records, evidence and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import PASTED_OUTPUT, any_word, capture_reason, content_shape, fingerprint, let, normalized

#: The forms of file names in notes, of claim keys, of headings, of notes on a passing state and of machine content.
PATH = r"(?<![\p{L}\p{N}_/.-])((?:[\p{L}\p{N}_.-]+/)*[\p{L}\p{N}_.-]+\.(?:py|md|json|jsonl|toml|js|ts|tsx|css|html|yml|yaml|sh|ps1|txt|cfg|ini))(?![\p{L}\p{N}_])"
CLAIM_KEY = r"^[a-z0-9][a-z0-9_-]*(?:[.:][a-z0-9][a-z0-9_-]*)+$"
HEADING = r"^\s*(?:#{1,6}\s|\d{1,2}[.)]\s|[-*•]\s|[A-Z][A-Z0-9]{3,}-\d+\b)"
STATUS_NOTE = any_word("currently", "right now", "still", "in progress", "for now", "şu an(da)?", "hâlâ", "halen", "devam ediyor", "bekleniyor")
MACHINE = r"(?m)```|^[+\-]{3} [ab]/|^@@ |^\s*\+\s*$|\\n[^\n]*\\n|\\u00|\x1b|\{\\?\"[\w-]+\\?\"\s*:|\{\x27[\w-]+\x27\s*:"
DOCUMENT_CHARS, DOCUMENT_LINES, DOCUMENT_HEADINGS = 1500, 25, 5
CLAIM_KEY_CHARS, PROBATION_DAYS, STATUS_NOTE_DAYS, SHORT, LONG, CARD_CHARS = 80, 14, 14, 20, 600, 3000


def sha16(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def inferred_scope(records: DataFrame) -> DataFrame:
    """`records` (raw_scope, label, raw_project_id) with scope, project and project_id: an unknown scope follows from the project's data, a
    global record has no project, a label alone stands for an id of its own."""
    label, given = F.trim(F.coalesce("label", F.lit(""))), F.trim(F.coalesce("raw_project_id", F.lit("")))
    scope = F.when(F.col("raw_scope").isin("global", "project"), F.col("raw_scope")).when((label != "") | (given != ""), "project").otherwise("global")
    own_id = F.when((given == "") & (label != ""), F.concat(F.lit("legacy-"), sha16(F.lower(label)))).otherwise(given)
    is_global = scope == "global"
    return records.withColumns({"scope": scope, "project": F.when(is_global, "").otherwise(label), "project_id": F.when(is_global, "").otherwise(own_id)})


def migrated(records: DataFrame) -> DataFrame:
    """memory_id, scope, project_id, fingerprint, changed: the records under their inferred scopes, and whether that changes them."""
    now = inferred_scope(records)
    changed = ~(F.col("raw_scope").eqNullSafe(F.col("scope")) & F.coalesce("raw_project_id", F.lit("")).eqNullSafe(F.col("project_id")))
    return now.select("memory_id", "scope", "project_id", fingerprint(F.col("scope"), F.col("project_id"), F.col("type"), F.col("content")).alias("fingerprint"), changed.alias("changed"))


def fingerprint_aliases(scope: Column, project_id: Column, kind: Column, content: Column) -> Column:
    """The current key, the key without a type, and for global records the key of the content alone; each once, in this order."""
    keys = F.array(fingerprint(scope, project_id, kind, content), fingerprint(scope, project_id, F.lit(""), content), F.when(scope == "global", sha16(normalized(content))))
    return F.array_compact(F.array_distinct(keys))


def merged_with_prior(proposed: DataFrame, prior: DataFrame) -> DataFrame:
    """(memory_id, candidate_id, origin): each proposal under the id of the first stored record (by time and id, none superseded) that has
    one of its keys, the current key before the older ones, else as new; and the stored records that no proposal took, kept."""
    keys = lambda df: fingerprint_aliases(F.col("scope"), F.col("project_id"), F.col("type"), F.col("content"))
    stored = prior.where("status != 'superseded'").select("memory_id", "at_s", F.explode(keys(prior)).alias("key"))
    first = stored.groupBy("key").agg(F.min(F.struct("at_s", "memory_id")).alias("x")).select("key", F.col("x.memory_id").alias("known"))
    asked = proposed.select("candidate_id", F.posexplode(keys(proposed)).alias("place", "key"))
    taken = asked.join(first, "key").groupBy("candidate_id").agg(F.min_by("known", "place").alias("known"))
    matched = proposed.select("candidate_id").join(taken, "candidate_id", "left").select(F.coalesce("known", F.lit("")).alias("memory_id"), "candidate_id", F.when(F.col("known").isNull(), "new").otherwise("matched").alias("origin"))
    kept = prior.select("memory_id").join(taken.select(F.col("known").alias("memory_id")), "memory_id", "left_anti").select("memory_id", F.lit("").alias("candidate_id"), F.lit("kept").alias("origin"))
    return matched.unionByName(kept)


def claim_key(raw: Column) -> Column:
    """The key in lower case, '' for none, null if malformed."""
    key = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(key == "", "").when((F.length(key) <= CLAIM_KEY_CHARS) & key.rlike(CLAIM_KEY), key)


def claim_holders(records: DataFrame) -> DataFrame:
    """(id, holder): for each record with a claim key the first other active record of its scope and project that holds the key."""
    key = ["scope", "project_id", "claim_key"]
    claims = records.where("claim_key != ''")
    active = claims.where("status = 'active'").select("id", *key)
    first = active.groupBy(*key).agg(F.min("id").alias("first"))
    second = active.join(first, key).where("id != first").groupBy(*key).agg(F.min("id").alias("second"))
    met = claims.join(first, key).join(second, key, "left")
    return met.select("id", F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second")).alias("holder")).where("holder is not null")


def reference_health(references: DataFrame, records: DataFrame) -> DataFrame:
    """`references` (project, memory_id), each once, with health: valid, dangling or wrong_project."""
    known = records.select("memory_id", "scope", "project_id", "status")
    met = references.distinct().join(known, "memory_id", "left")
    allowed = F.col("status").isin("active", "resolved", "superseded")
    fits = (F.col("scope") == "global") | (F.col("project_id") == F.col("project"))
    return met.select("project", "memory_id", F.when(~F.coalesce(allowed, F.lit(False)), "dangling").when(fits, "valid").otherwise("wrong_project").alias("health"))


def provenance_split(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """(kind, n): where active records (source, source_id) came from, with the reasons of `accepted` review items (candidate_id, reason)."""
    by_id = accepted.groupBy("candidate_id").agg(F.max("reason").alias("reason"))
    met = records.where("status = 'active'").join(by_id, F.regexp_replace("source_id", "^truth:", "") == F.col("candidate_id"), "left")
    kind = F.when(F.col("source") == "remember", "remember").when(F.col("source") != "worker", "other").when(F.col("reason") == "BACKFILL", "backfill_accepted").when(F.col("reason").isNotNull(), "captured_accepted").otherwise("captured_direct")
    return met.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def referenced_paths(content: Column) -> Column:
    """The different file names in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(PATH), F.lit(1)), lambda p: F.regexp_replace(p, r"^[./]+|[./]+$", ""))))


def stale_records(records: DataFrame, files: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """(memory_id, path, reason): active records that name a file which changed after they were written, or is gone (changed_s null),
    without those that someone acknowledged for that very change. Names that `files` (project_id, path, changed_s) lacks are no evidence."""
    named = records.where("status = 'active'").select("memory_id", "project_id", "at_s", F.explode(referenced_paths(F.col("content"))).alias("path"))
    met = named.join(files, ["project_id", "path"]).where("changed_s is null or changed_s > at_s")
    seen = acknowledged.select(F.col("memory_id").alias("m"), F.col("path").alias("p"), F.col("changed_s").alias("c"))
    fresh = met.join(seen, (F.col("memory_id") == F.col("m")) & (F.col("path") == F.col("p")) & (F.col("changed_s") == F.col("c")), "left_anti")
    return fresh.select("memory_id", "path", F.when(F.col("changed_s").isNull(), "SOURCE_MISSING").otherwise("SOURCE_CHANGED").alias("reason"))


def containing_roots(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """`paths` (path), each once, with the root of the deepest project that holds it ('' if none)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = paths.select("path").distinct().select("path", F.explode(above).alias("root"))
    best = each.join(projects.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("root", F.lit("")).alias("root"))


def overlapping(spans: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of `spans` (first_s, last_s) that overlap the window [start, end)."""
    return spans.where((F.col("first_s") < end) & (F.col("last_s") >= start))


def noise_rule(reason: Column, commitment: Column, kind: Column, content: Column) -> Column:
    """The first noise rule that a waiting candidate matches, '' if none; a committed decision matches none."""
    return let(F.struct(commitment.alias("c"), content_shape(content).alias("s")), lambda x: _noise(reason, x["c"], kind, x["s"]))


def _noise(reason: Column, commitment: Column, kind: Column, shape: Column) -> Column:
    return (
        F.when((commitment == "COMMITTED") & (kind == "decision"), "")
        .when(commitment == "QUOTED", "QUOTED")
        .when(shape == "short_ack", "SHORT_ACK")
        .when((reason == "LOW_EVIDENCE_COMMITMENT") & (shape == "prose"), "LOW_EVIDENCE_PROSE")
        .when((reason == "LOW_EVIDENCE_COMMITMENT") & (shape == "terminal_or_code"), "LOW_EVIDENCE_CODE")
        .when((reason == "LIFECYCLE_TARGET_UNKNOWN") & (commitment == "OBSERVED"), "OBSERVED_UNKNOWN_TARGET")
        .otherwise("")
    )


def rule_verdict(content: Column, commitment: Column, is_state: Column, similarity: Column) -> Column:
    """Why the rules reject a candidate, '' if they leave it to a reader. They never accept."""
    x = F.trim(content)
    return (
        F.when(x.rlike(PASTED_OUTPUT), "PASTED_OUTPUT")
        .when(x.rlike(MACHINE), "MACHINE_CONTENT")
        .when(F.length(x) > LONG, "TOO_LONG")
        .when(F.length(x) < SHORT, "TOO_SHORT")
        .when(commitment == "QUESTION", "QUESTION")
        .when(is_state & (commitment != "COMMITTED"), "STATE_NOT_COMMITTED")
        .when(similarity >= 0.6, "DUPLICATE")
        .otherwise("")
    )


def refusal(content: Column) -> Column:
    """The code with which the review store refuses a content, '' if it takes it."""
    reason = capture_reason(content)
    return F.when(reason != "", F.concat(F.lit("UNSAFE_"), F.upper(reason))).when(F.length(content) > 8000, "UNSAFE_PAYLOAD_TOO_LARGE").otherwise("")


def agent_readable(approved: Column, content: Column, approved_only: bool) -> Column:
    return (approved | F.lit(not approved_only)) & (capture_reason(content) == "")


def pasted_document(content: Column) -> Column:
    """Whether a turn is a long, structured document: many lines, or several headings."""
    lines = F.filter(F.split(content, "\n"), lambda y: F.trim(y) != "")
    headings = F.size(F.filter(lines, lambda y: y.rlike(HEADING)))
    return (F.length(content) >= DOCUMENT_CHARS) & ((F.size(lines) >= DOCUMENT_LINES) | (headings >= DOCUMENT_HEADINGS))


def stale_status_notes(records: DataFrame, as_of: int) -> DataFrame:
    """(memory_id): active observations on a passing state that are two weeks old."""
    old = F.lit(as_of) - F.col("at_s") >= STATUS_NOTE_DAYS * 86400
    return records.where((F.col("status") == "active") & (F.col("type") == "observation") & old & F.lower("content").rlike(STATUS_NOTE)).select("memory_id")


def on_probation(records: DataFrame, accepted: DataFrame, as_of: int) -> DataFrame:
    """(memory_id): active records of the worker, younger than `PROBATION_DAYS`, that no person accepted (`accepted`: memory_id)."""
    age = F.lit(as_of) - F.col("at_s")
    young = records.where((F.col("status") == "active") & (F.col("source") == "worker") & (age >= 0) & (age < PROBATION_DAYS * 86400))
    return young.select("memory_id").join(accepted.select("memory_id").distinct(), "memory_id", "left_anti")


def previous_messages(turns: DataFrame) -> DataFrame:
    """(session, ordinal, before): each user turn with the ordinal of the turn before it."""
    order = Window.partitionBy("session").orderBy("ordinal")
    return turns.select("session", "ordinal", "role", F.lag("ordinal").over(order).alias("before")).where("role = 'user' and before is not null").drop("role")


def latest_receipts(receipts: DataFrame) -> DataFrame:
    """(session, ordinal, at_s, action): the last receipt of each session, by time and ordinal."""
    return receipts.groupBy("session").agg(F.max(F.struct("at_s", "ordinal", "action")).alias("x")).select("session", "x.ordinal", "x.at_s", "x.action")


def kept_cards(cards: DataFrame) -> DataFrame:
    """(project, session): the newest cards (project, session, updated, size) of each project until their sizes pass `CARD_CHARS`; the
    newest stays in any case."""
    order = Window.partitionBy("project").orderBy(F.desc("updated"), "session")
    placed = cards.select("project", "session", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"), F.row_number().over(order).alias("place"))
    return placed.where((F.col("place") == 1) | (F.col("used") <= CARD_CHARS)).select("project", "session")


def merged_caches(disk: DataFrame, own: DataFrame) -> DataFrame:
    """(key, value, origin): both caches in one; where both have a key, the lesser value stays."""
    met = disk.select("key", F.col("value").alias("a")).join(own.select("key", F.col("value").alias("b")), "key", "full")
    return met.select("key", F.least("a", "b").alias("value"), F.when(F.col("b").isNull(), "disk").when(F.col("a").isNull(), "own").otherwise("both").alias("origin"))


def evidence_trail(records: DataFrame, turns: DataFrame) -> DataFrame:
    """(memory_id, session, status): each evidence reference of a record (refs: sessions), found with its turns, found without, or missing."""
    refs = records.select("memory_id", F.explode_outer("refs").alias("session"))
    there = turns.groupBy("session").agg(F.count_if(F.col("role") == "user").alias("asked"))
    met = refs.join(there, "session", "left")
    return met.select("memory_id", F.coalesce("session", F.lit(-1)).alias("session"), F.when(F.col("session").isNull(), "no_reference").when(F.col("asked").isNull(), "missing").when(F.col("asked") == 0, "no_user_turn").otherwise("found").alias("status"))


def sole_carriers(records: DataFrame, holds: dict[str, Column]) -> DataFrame:
    """(question, project_id, memory_id): the records that alone answer a question in their project; `holds` says which answer it."""
    answered = F.filter(F.array(*[F.struct(F.lit(q).alias("q"), c.alias("c")) for q, c in holds.items()]), lambda x: x["c"])
    each = records.select("memory_id", "project_id", F.explode(answered).alias("x")).select("memory_id", "project_id", F.col("x.q").alias("question"))
    return each.groupBy("question", "project_id").agg(F.count("*").alias("n"), F.min("memory_id").alias("memory_id")).where("n = 1").drop("n")


def topic_counts(records: DataFrame) -> DataFrame:
    """(project_id, topic, n): active records by project and topic; '' counts those without a topic."""
    return records.where("status = 'active'").groupBy("project_id", F.coalesce("topic", F.lit("")).alias("topic")).agg(F.count("*").alias("n"))


def digest_envelope(records: DataFrame, since: int) -> DataFrame:
    """(type, considered, first_day, last_day): what a digest from `since` on looks at, by type; days since 1970."""
    day = F.floor(F.col("at_s") / 86400)
    return records.where(F.col("at_s") >= since).groupBy("type").agg(F.count("*").alias("considered"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
