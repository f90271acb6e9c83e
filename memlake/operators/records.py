"""Record upkeep: duplicate plans, supersession chains, anomalies, contradictions, validation and truth decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring
from memlake.functions.text import capture_reason, fingerprint, tokens
from memlake.lineage import cut

from .paths import chain_ends
from .similarity import copies_of, first_rows, keyed, similar_sets

DUPLICATE_FROM = 0.6
#: Terms that contradict each other; the last three hold only against stored decisions.
CONTRADICTIONS = (("use", "don't use"), ("should", "shouldn't"), ("will", "won't"), ("yes", "no"), ("enable", "disable"), ("proceed", "abort"), ("phased", "monolithic"), ("async", "sync"), ("distributed", "monolithic"), ("microservices", "monolith"))
IN_BATCH = 7
SEVERITY = {"critical": 0, "warning": 1, "info": 2}


def with_fingerprint(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", fingerprint(F.col("scope"), F.col("project_id"), F.col("type"), F.col("content")))


def dedupe_plan(records: DataFrame) -> DataFrame:
    """(memory_id, survivor): records to retire. Of the records of a fingerprint that are not superseded, the first by time and id stays.

    The survivor is aggregated before it meets the others, so a large group of copies is spread over tasks by the join.
    """
    live = with_fingerprint(records).where(F.col("status") != "superseded").select("memory_id", "fingerprint", "at_s")
    first = live.groupBy("fingerprint").agg(F.min(F.struct("at_s", "memory_id")).alias("x"), F.count("*").alias("n")).where("n > 1").select("fingerprint", F.col("x.memory_id").alias("survivor"))
    return live.join(first, "fingerprint").where("memory_id != survivor").select("memory_id", "survivor")


def supersession_chains(records: DataFrame) -> DataFrame:
    """(memory_id, hops, last, unfinished): where superseded_by leads from each record that has one, to the chain's end. A chain that runs
    into a cycle is unfinished, without hops and last."""
    ends = chain_ends(records.select(F.col("memory_id").alias("id"), F.col("superseded_by").alias("next")))
    return records.where("superseded_by != ''").select(F.col("memory_id").alias("id")).join(ends, "id").select(F.col("id").alias("memory_id"), "hops", "last", "unfinished")


def duplicate_content(records: DataFrame, least: float = DUPLICATE_FROM) -> DataFrame:
    """(a, b, similarity) among active records of a type: pairs of different token sets, each by its first record, and every copy with the first."""
    live = records.where(F.col("status") == "active").select(F.col("store_ordinal").alias("id"), F.col("type").alias("block"), tokens(F.col("content")).alias("tokens"))
    rows = keyed(live)
    copied = copies_of(rows)
    return similar_sets(first_rows(rows, copied), least).union(copied.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def anomalies(records: DataFrame, as_of: int, duplicates: bool = True) -> DataFrame:
    """(detector, severity, memory_id, figure) of the seven detectors."""
    row = lambda detector, severity, df, figure: df.select(F.lit(detector).alias("detector"), F.lit(severity).alias("severity"), "memory_id", figure.cast("double").alias("figure"))
    age = (F.lit(as_of) - F.col("at_s")) / 86400
    gap = F.abs(F.col("quality_score") - F.col("confidence"))
    found = [
        row("stale_open_loop", "warning", records.where((F.col("type") == "open_loop") & (F.col("status") == "active") & (age >= 3)), age),
        row("low_confidence_outlier", "info", records.where(F.col("is_approved") & (F.coalesce("confidence", F.lit(1.0)) < 0.3)), F.col("confidence")),
        row("quality_confidence_gap", "info", records.where(F.round(gap, 9) >= 0.5), gap),
        row("burst_ingestion", "warning", bursts(records).select(F.col("first_id").alias("memory_id"), "n"), F.col("n")),
        row("broken_supersession", "critical", broken_supersession(records), F.lit(1.0)),
        row("trivial_content", "info", records.where(F.length(F.trim("content")) < 10), F.length(F.trim("content"))),
    ]
    if duplicates:
        pairs = duplicate_content(records).select(F.concat(F.lit("mem_"), F.lpad(F.col("b").cast("string"), 8, "0")).alias("memory_id"), "similarity")
        found.insert(0, row("duplicate_content", "warning", pairs, F.col("similarity")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def bursts(records: DataFrame, least: int = 15) -> DataFrame:
    """(at, n, first_id): moments at which `least` records or more were made."""
    return records.where("at_s is not null").groupBy("at_s").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id")).where(F.col("n") >= least)


def broken_supersession(records: DataFrame) -> DataFrame:
    """Records whose superseded_by is no record."""
    ids = records.select(F.col("memory_id").alias("known"))
    return records.where("superseded_by != ''").join(ids, F.col("superseded_by") == F.col("known"), "left_anti")


def anomaly_report(found: DataFrame) -> DataFrame:
    """(detector, severity, n): counts by detector, by severity and in all, in one pass of grouping sets; '' stands for every value."""
    sets = found.groupingSets([[F.col("detector")], [F.col("severity")], []], F.col("detector"), F.col("severity")).agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("detector", F.lit("")).alias("detector"), F.coalesce("severity", F.lit("")).alias("severity"), "n")


def contradictions(decisions: DataFrame, against: DataFrame, terms: int) -> DataFrame:
    """(id, term, others, first_other): the first pair of terms on which a decision and decisions of `against` (both id, scope,
    project_id, content) stand on different sides, how many those are and the least of their ids.

    Sides are counted per scope, project and pair before they meet, so the result has a row per decision and never one per pair.
    """

    pairs = CONTRADICTIONS[:terms]
    words = sorted({w for pair in pairs for w in pair}, key=len, reverse=True)
    # at each place where a word begins, the longest term that stands there: one pass finds all terms, also those within others
    standing = rf"(?<![a-z0-9_'])(?=({'|'.join(words)})(?![a-z0-9_']))"
    meaning = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("term"), F.lit(side).alias("side")) for k, pair in enumerate(pairs) for side, v in enumerate(pair) if v == w]))])

    def sides(df: DataFrame) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("content")), F.lit(standing), F.lit(1)))
        each = df.select("id", "scope", "project_id", F.explode_outer(found).alias("word")).where("word is not null")
        return cut(each.select("id", "scope", "project_id", F.explode(F.element_at(meaning, F.col("word"))).alias("x")).select("id", "scope", "project_id", "x.term", "x.side").distinct())

    own, key = sides(decisions), ["scope", "project_id", "term", "side"]
    facing = (own if against is decisions else sides(against)).withColumn("side", 1 - F.col("side"))
    firsts = facing.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    seconds = facing.join(firsts, key).where("id != first").groupBy(*key).agg(F.min("id").alias("second"))
    # A decision that holds both sides of a pair does not stand against itself.
    itself = own.select("id", *key, F.lit(1).alias("both")).join(facing.select("id", *key), ["id", *key], "left_semi")
    met = own.join(firsts, key).join(seconds, key, "left").join(itself, ["id", *key], "left")
    first = F.when(F.col("both").isNotNull() & (F.col("first") == F.col("id")), F.col("second")).otherwise(F.col("first"))
    met = met.select("id", *key, (F.col("n") - F.coalesce("both", F.lit(0))).alias("others"), first.alias("first_other")).where("others > 0")
    least = met.groupBy("id").agg(F.min(F.struct("term", "side", "others", "first_other")).alias("x"))
    return least.select("id", "x.term", "x.others", "x.first_other")


def validated(records: DataFrame, as_of: int) -> DataFrame:
    """memory_id, quality, approved: the validator's score with the issues found on each record (an unsafe content is an error, a contradiction within
    the batch a warning)."""
    decisions = records.where(F.col("type") == "decision").select(F.col("store_ordinal").alias("id"), "scope", "project_id", "content")
    warned = contradictions(decisions, decisions, IN_BATCH).select(F.col("id").alias("warned"))
    seen = records.join(warned, F.col("store_ordinal") == F.col("warned"), "left")
    errors = F.when(capture_reason(F.col("content")) != "", 1).otherwise(0)
    score = scoring.validated_quality(F.col("confidence"), F.col("novelty"), F.col("type"), F.col("at_s"), as_of, errors, F.when(F.col("warned").isNotNull(), 1).otherwise(0))
    return seen.select("memory_id", F.round(score, 6).alias("quality"), (F.round(score, 9) > 0.55).alias("approved"))


def truth_decisions(proposed: DataFrame, records: DataFrame, projects: DataFrame) -> DataFrame:
    """candidate_id, action, reason, target: the decision on each proposal of a new record, by fixed precedence.

    Unsafe contents and unusable projects are rejected, then unapproved and uncommitted proposals wait for review; a proposal with the
    fingerprint of a stored record of its scope is a duplicate of the first such, the rest is new.
    """
    keyed = with_fingerprint(proposed)
    stored = with_fingerprint(records).groupBy("fingerprint").agg(F.min("store_ordinal").alias("first"))
    own = projects.select(F.col("project_id").alias("known"), F.col("status").alias("project_status"), "proactive_capture")
    seen = keyed.join(stored, "fingerprint", "left").join(own, F.col("project_id") == F.col("known"), "left")
    reason = capture_reason(F.col("content"))
    of_project = F.col("scope") == "project"
    why = (
        F.when(reason != "", F.upper(reason))
        .when((F.col("scope") == "global") & (F.col("project_id") != ""), "GLOBAL_WITH_PROJECT")
        .when(of_project & F.col("known").isNull(), "PROJECT_UNREGISTERED")
        .when(of_project & (F.col("project_status") == "archived"), "PROJECT_ARCHIVED")
        .when(of_project & ~F.col("proactive_capture"), "CAPTURE_DISABLED")
        .when(~F.col("approved"), "UNAPPROVED_CANDIDATE")
        .when(F.col("commitment") != "COMMITTED", "UNCOMMITTED_CANDIDATE")
        .when(F.col("first").isNotNull(), "EQUAL_FINGERPRINT")
        .otherwise("")
    )
    action = lambda w: F.when(w == "", "NEW").when(w == "EQUAL_FINGERPRINT", "DUPLICATE").when(w.isin("UNAPPROVED_CANDIDATE", "UNCOMMITTED_CANDIDATE"), "REVIEW").otherwise("REJECT")
    rated = seen.withColumn("reason", why)
    return rated.select("candidate_id", action(F.col("reason")).alias("action"), "reason", F.when(F.col("reason") == "EQUAL_FINGERPRINT", F.col("first")).otherwise(F.lit(-1)).alias("target"))


def review_primaries(items: DataFrame) -> DataFrame:
    """candidate_id, duplicates: of the waiting items of a project and content, the surest and oldest, with the number of the others."""
    key = [F.col("project_id"), F.col("scope"), F.col("type"), F.sha2("content", 256)]
    best = items.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "created", "candidate_id")).alias("x"), (F.count("*") - 1).alias("duplicates"))
    return best.select("x.candidate_id", "duplicates")


def store_violations(records: DataFrame) -> DataFrame:
    """memory_id, violations: the broken rules of each record that breaks any, comma-joined."""
    rules = {
        "content_empty": F.trim("content") == "", "type_unknown": ~F.col("type").isin("decision", "lesson", "open_loop", "observation", "preference"),
        "status_unknown": ~F.col("status").isin("active", "resolved", "superseded"), "global_with_project": (F.col("scope") == "global") & (F.col("project_id") != ""),
        "project_without_id": (F.col("scope") == "project") & (F.col("project_id") == ""), "superseded_without_target": (F.col("status") == "superseded") & (F.col("superseded_by") == ""),
        "confidence_range": ~F.col("confidence").between(0, 1), "quality_low_but_approved": F.col("is_approved") & (F.col("quality_score") < 0.05),
    }
    broken = F.concat_ws(",", *[F.when(v, k) for k, v in rules.items()])
    return records.select("memory_id", broken.alias("violations")).where("violations != ''")


def resolve_records(records: DataFrame, ids: Column, note: str) -> DataFrame:
    """The records with those of `ids` (a condition) marked as resolved."""
    return records.withColumn("status", F.when(ids, "resolved").otherwise(F.col("status"))).withColumn("resolution_note", F.when(ids, note))
