"""Propositions of an extractor: untrusted JSON against a closed schema, then the gates of role, commitment and scope."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema, and the keys that no nested object may have.
VERSION = "ig01-a-proposition-v1"
REQUIRED = ("candidate_id", "project_id", "claim_type", "commitment", "source_role", "evidence_refs", "confidence_components", "schema_version")
OPTIONAL = ("subject", "predicate", "value", "temporal_scope", "correction_clues", "target_clues")
ROLES = ("user", "assistant", "tool", "system", "summary", "subagent", "unknown")
COMMITMENTS = ("committed", "proposed", "hypothetical", "question", "negated", "quoted", "observed", "uncertain", "explicit", "implicit", "none", "no_commitment")
COMMITTING = ("committed", "explicit", "implicit")
TEMPORAL, CORRECTION, TARGET = ("start", "end", "precision"), ("old_value", "new_value", "claim_key", "reason"), ("named_id", "claim_key", "lineage_id", "reference_kind")
RESERVED = ("canonical_commit", "write_memory", "write_state", "lifecycle_operation", "memory_store", "state_store", "prompt", "transcript", "raw_prompt", "raw_transcript", "content", "text", "token", "tokens", "secret", "password", "credential", "api_key")
MOST_DEPTH = 3
QUESTION = r"(?i)\?|(?:^|[^\p{L}\p{N}_])(?:should we|could we|shall we|what if|kullansak|yapalım mı|geçelim mi)(?:$|[^\p{L}\p{N}_])"
HYPOTHETICAL = r"(?i)(?:^|[^\p{L}\p{N}_])(?:maybe|perhaps|might|could|we could|we might|consider|belki|olabilir|kullanabiliriz)(?:$|[^\p{L}\p{N}_])"
QUOTE = r"""(?is)(?:^|\s)["'“‘].*["'”’](?:$|\s)|(?:^|[^\p{L}\p{N}_])(?:quoted|quote|alıntı|dokümanda)(?:$|[^\p{L}\p{N}_])"""

ZONED = r"(?:Z|[+-]\d\d:\d\d)$"


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__or__, conditions)


def _at(v: Column, field: str) -> Column:
    """A field as a variant; null where it is missing."""
    return F.try_variant_get(v, f"$.{field}", "variant")


def _kind(x: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, ARRAY<..>, OBJECT<..>, VOID; '' for what is missing."""
    return F.coalesce(F.schema_of_variant(x), F.lit(""))


def _text(v: Column, field: str) -> Column:
    return F.when(_kind(_at(v, field)) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _blank(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\s*$"), F.lit(True))


def _no_string(v: Column, field: str, required: bool = True) -> Column:
    """Whether a field is anything but a string that says something, or, where it is not required, null or missing."""
    bad = _blank(_text(v, field))
    return bad if required else bad & ~_kind(_at(v, field)).isin("", "VOID")


def _keys(x: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>"))


def _bad_object(v: Column, field: str, allowed: tuple[str, ...]) -> Column:
    """Whether an optional field is neither an object nor null, or has a key that it may not have."""
    x = _at(v, field)
    is_object = F.startswith(_kind(x), F.lit("OBJECT"))
    return (~is_object & ~_kind(x).isin("", "VOID")) | (is_object & (F.size(F.array_except(_keys(x), F.array(*map(F.lit, allowed)))) > 0))


def _bad_nested(x: Column) -> Column:
    """Whether an inner object has a reserved or blank key, or something lies deeper than MOST_DEPTH."""
    json = F.coalesce(F.to_json(x), F.lit(""))
    keys = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)":'), F.lit(1))
    named = F.exists(keys, lambda k: F.lower(F.trim(k)).isin(*RESERVED) | _blank(k))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "s"), r"\{\}|\[\]", "s"), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    deepest = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"])
    return named | (deepest > MOST_DEPTH)


def is_invalid(v: Column) -> Column:
    """Whether a variant is no proposition of the schema."""
    refs = F.try_variant_get(v, "$.evidence_refs", "array<variant>")
    strings = F.transform(refs, lambda r: F.when(F.schema_of_variant(r) == "STRING", F.trim(F.try_variant_get(r, "$", "string"))))
    parts = F.map_entries(F.try_variant_get(v, "$.confidence_components", "map<string,variant>"))
    number = lambda e: F.try_variant_get(e["value"], "$", "double")
    numeric = lambda e: F.schema_of_variant(e["value"]).rlike("^(BIGINT|DECIMAL|DOUBLE)") & number(e).between(0, 1) & ~_blank(e["key"])
    start, end = _text(v, "temporal_scope.start"), _text(v, "temporal_scope.end")
    both = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    moments = F.try_to_timestamp(start), F.try_to_timestamp(end)
    unordered = both & ~F.coalesce(start.rlike(ZONED) & end.rlike(ZONED) & (moments[0] <= moments[1]), F.lit(False))
    no_string = lambda f: _no_string(v, f) & (_kind(_at(v, f)) != "")
    return F.coalesce(_any([
        ~F.startswith(_kind(v), F.lit("OBJECT")), F.size(F.array_except(_keys(v), F.array(*map(F.lit, REQUIRED + OPTIONAL)))) > 0,
        *[_kind(_at(v, f)) == "" for f in REQUIRED], *[_no_string(v, f) for f in ("candidate_id", "claim_type", "source_role", "commitment", "schema_version")], *[_no_string(v, f, False) for f in ("project_id", "subject", "predicate")],
        ~F.coalesce(F.lower(F.trim(_text(v, "source_role"))).isin(*ROLES), F.lit(False)), ~F.coalesce(F.lower(F.trim(_text(v, "commitment"))).isin(*COMMITMENTS), F.lit(False)), ~F.coalesce(F.trim(_text(v, "schema_version")) == VERSION, F.lit(False)),
        ~F.startswith(_kind(_at(v, "evidence_refs")), F.lit("ARRAY")), F.coalesce(F.size(refs), F.lit(0)) < 1, F.exists(strings, _blank), F.size(F.array_distinct(strings)) < F.size(strings),
        ~F.startswith(_kind(_at(v, "confidence_components")), F.lit("OBJECT")), F.coalesce(F.size(parts), F.lit(0)) < 1, ~F.coalesce(F.forall(parts, numeric), F.lit(False)),
        _bad_object(v, "temporal_scope", TEMPORAL), *[~_kind(_at(v, f"temporal_scope.{f}")).isin("", "STRING") for f in ("start", "end")], unordered,
        _bad_object(v, "correction_clues", ("explicit", *CORRECTION)), ~_kind(_at(v, "correction_clues.explicit")).isin("", "BOOLEAN"), *[no_string(f"correction_clues.{f}") for f in CORRECTION],
        _bad_object(v, "target_clues", TARGET), *[no_string(f"target_clues.{f}") for f in TARGET],
        *[_bad_nested(_at(v, f)) for f in ("value", "temporal_scope", "correction_clues", "target_clues")],
    ]), F.lit(True))


def judged(payloads: DataFrame) -> DataFrame:
    """(id, valid, canonical, review, code) of `payloads` (id, payload as text, flags as an array of question, hypothetical, quoted): the
    first gate that a proposition does not pass, VALIDATED for what may become canonical. Broken JSON is an invalid proposition."""
    v = F.col("v")
    seen = payloads.select("id", "flags", F.try_parse_json("payload").alias("v"))
    rated = seen.select("id", "flags", "v", is_invalid(v).alias("bad"), F.lower(F.trim(_text(v, "commitment"))).alias("commitment"), F.lower(F.trim(_text(v, "source_role"))).alias("role"), F.coalesce(_text(v, "value"), F.to_json(_at(v, "value")), F.lit("")).alias("said"), _text(v, "project_id").alias("project"))
    commits, flagged = F.col("commitment").isin(*COMMITTING), lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False))
    said = F.col("said")
    code = (
        F.when(F.col("bad"), "INVALID_PROPOSITION")
        .when(F.col("role").isin("assistant", "tool", "system") & commits, "NON_USER_COMMITMENT")
        .when((F.col("role") == "unknown") & commits, "UNKNOWN_SOURCE_ROLE")
        .when(F.col("commitment").isin("question", "hypothetical"), "NON_COMMITMENT")
        .when(commits & flagged("question"), "QUESTION_COMMITMENT")
        .when(commits & flagged("hypothetical"), "HYPOTHETICAL_COMMITMENT")
        .when(commits & flagged("quoted"), "QUOTED_COMMITMENT")
        .when(commits & said.rlike(QUESTION), "QUESTION_COMMITMENT")
        .when(commits & said.rlike(HYPOTHETICAL), "HYPOTHETICAL_COMMITMENT")
        .when(commits & said.rlike(QUOTE), "QUOTED_COMMITMENT")
        .when(F.col("project").isNull(), "SCOPE_UNRESOLVED")
        .when((F.col("role") == "user") & commits, "VALIDATED")
        .otherwise("REVIEW_REQUIRED")
    )
    valid = F.col("code").isin("NON_COMMITMENT", "SCOPE_UNRESOLVED", "VALIDATED", "REVIEW_REQUIRED")
    return rated.select("id", code.alias("code")).select("id", valid.alias("valid"), (F.col("code") == "VALIDATED").alias("canonical"), (F.col("code") != "VALIDATED").alias("review"), "code")
