"""The truth engine as one operator: receipts of past operations, policy, decisions on what is new, their effects, and new receipts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import capture_reason
from memlake.lineage import cut

from .lifecycle import committed, lifecycle_decisions

#: Codes of unsafe contents, and the decisions that keep an operation from being receipted.
SAFETY = {"potential_secret": "SECRET_CONTENT", "payload_too_large": "CAPTURE_TOO_LARGE", "too_many_lines": "CAPTURE_TOO_MANY_LINES", "transcript_like": "CAPTURE_TRANSCRIPT_LIKE"}
UNSETTLED = ("REJECT", "REVIEW_REQUIRED", "CONFLICT")
TARGETED = ("SUPERSEDE_EXISTING", "RESOLVE_EXISTING", "CONFIRM_EXISTING")
#: What an operation asks, and on whose word; the hash of each is its identity.
REQUEST = ("candidate_id", "content", "type", "scope", "project_id", "fingerprint", "claim_key", "commitment", "confidence", "operation", "target_id", "successor_id", "confirms")
PROVENANCE = ("source", "approved")


def _digest(columns: tuple[str, ...]) -> Column:
    """SHA-256 over position and fields of a candidate."""
    return F.sha2(F.to_json(F.struct(F.col("position"), *[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def prepared(proposed: DataFrame) -> DataFrame:
    """`proposed` with what is read off its contents: why they are unsafe, and the digests of what is asked and on whose word."""
    return proposed.withColumns({"unsafe": capture_reason(F.col("content")), "request": _digest(REQUEST), "provenance": _digest(PROVENANCE)})


def _sum_hash(digest: Column) -> Column:
    """A hash of an operation's rows in their order, as an aggregate: slices of the digests, summed exactly. Nothing is gathered, however
    many candidates an operation has."""
    slices = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[s.cast("string") for s in slices]), 256)


def operation_hashes(proposed: DataFrame) -> DataFrame:
    """(operation_id, request_hash, provenance_hash, stated) of each batch of candidates."""
    own = proposed if "request" in proposed.columns else proposed.select("operation_id", "position", "stated", _digest(REQUEST).alias("request"), _digest(PROVENANCE).alias("provenance"))
    return own.groupBy("operation_id").agg(_sum_hash(F.col("request")).alias("request_hash"), _sum_hash(F.col("provenance")).alias("provenance_hash"), F.max("stated").alias("stated"))


def operation_states(proposed: DataFrame, receipts: DataFrame, strict: bool = False) -> DataFrame:
    """(operation_id, request_hash, provenance_hash, state): DECIDE where an operation has no receipt, REPLAY where its hashes are the
    receipt's, MISMATCH where they differ; with `strict`, a mismatch fails the plan. A receipt without a provenance hash predates them and
    is replayed only for candidates that state neither source nor approval (`stated`)."""
    own = operation_hashes(proposed)
    prior = receipts.select("operation_id", F.col("request_hash").alias("old_request"), F.col("provenance_hash").alias("old_provenance"), F.lit(True).alias("known"))
    met = own.join(prior, "operation_id", "left")
    other = (F.col("request_hash") != F.col("old_request")) | F.when(F.col("old_provenance").isNull(), F.col("stated")).otherwise(F.col("provenance_hash") != F.col("old_provenance"))
    mismatch = F.raise_error(F.concat(F.lit("operation identity mismatch: "), "operation_id")).cast("string") if strict else F.lit("MISMATCH")
    state = F.when(F.col("known").isNull(), F.lit("DECIDE")).when(other, mismatch).otherwise("REPLAY")
    return met.select("operation_id", "request_hash", "provenance_hash", state.alias("state"))


def policy(proposed: DataFrame, projects: DataFrame) -> DataFrame:
    """`proposed` with `p_action` and `p_reason`, null where policy lets a candidate pass to the store: safety, project authority,
    approval, commitment and missing targets, in this order."""
    own = projects.select(F.col("project_id"), F.col("status").alias("registered"), "proactive_capture")
    judged = proposed if "unsafe" in proposed.columns else proposed.withColumn("unsafe", capture_reason(F.col("content")))
    met = judged.join(own, "project_id", "left")
    codes = F.create_map(*[F.lit(x) for pair in SAFETY.items() for x in pair])
    of_project = F.col("scope") == "project"
    reject = (
        F.when(F.col("unsafe") != "", F.element_at(codes, F.col("unsafe")))
        .when((F.col("scope") == "global") & (F.col("project_id") != ""), "GLOBAL_PROJECT_METADATA")
        .when(of_project & (F.col("project_id") == ""), "SCOPE_UNRESOLVED")
        .when(of_project & F.col("registered").isNull(), "PROJECT_UNREGISTERED")
        .when(of_project & (F.col("registered") == "archived"), "PROJECT_ARCHIVED")
        .when(of_project & ((F.col("registered") != "active") | ~F.coalesce("proactive_capture", F.lit(False))), "PROJECT_CAPTURE_DISABLED")
    )
    review = (
        F.when(F.col("stated") & ~F.col("approved"), "UNAPPROVED_CANDIDATE")
        .when(F.col("commitment") != "COMMITTED", "UNCOMMITTED_CANDIDATE")
        .when(~F.col("approved"), "UNAPPROVED_CANDIDATE")
        .when(F.col("operation").isin(*TARGETED) & (F.col("target_id") == ""), "LIFECYCLE_TARGET_UNKNOWN")
    )
    kept = met.withColumn("p_reject", reject).withColumn("p_review", review)
    action = F.when(F.col("p_reject").isNotNull(), "REJECT").when(F.col("p_review").isNotNull(), "REVIEW_REQUIRED")
    return kept.withColumn("p_action", action).withColumn("p_reason", F.coalesce("p_reject", "p_review")).drop("p_reject", "p_review", "unsafe", "registered", "proactive_capture")


RECORD = ("memory_id", "store_ordinal", "scope", "project_id", "claim_key", "fingerprint", "status", "superseded_by")
DECISION = ("operation_id", "position", "candidate_id", "action", "reason", "target", "successor")


@dataclass(frozen=True)
class Processed:
    """What processing a batch of operations gives: `operations` and their states, the `decisions` on every candidate of those that are not
    mismatched, the `records` after them, and all `receipts` and receipted decisions to keep."""

    operations: DataFrame
    decisions: DataFrame
    records: DataFrame
    receipts: DataFrame
    receipted: DataFrame

    def written(self, folder: str) -> Processed:
        """The same as tables in `folder`: what the next batch reads. Receipts go last, so that what stops before them is decided again."""
        names = ("operations", "decisions", "records", "receipted", "receipts")
        for name in names:
            getattr(self, name).write.parquet(f"{folder}/{name}")
        read = self.records.sparkSession.read
        return Processed(**{name: read.parquet(f"{folder}/{name}") for name in names})


def _decided(fresh: DataFrame, records: DataFrame, projects: DataFrame) -> DataFrame:
    """Decisions on candidates without a receipt, with the columns that their effects need."""
    judged = policy(fresh, projects)
    passing = judged.where("p_action is null").withColumn("key", F.concat_ws("/", "operation_id", F.col("position").cast("string")))
    found = lifecycle_decisions(passing.withColumn("candidate_id", F.col("key")), records).withColumnRenamed("candidate_id", "key")
    met = judged.withColumn("key", F.concat_ws("/", "operation_id", F.col("position").cast("string"))).join(found, "key", "left")
    met = met.select(*judged.columns, F.coalesce("p_action", "action").alias("action"), F.coalesce("p_reason", "reason").alias("reason"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("successor", F.lit("")).alias("successor"))
    # Of the new candidates of a fingerprint the first is stored; the others are its duplicates.
    key = ["scope", "project_id", "fingerprint"]
    new = F.col("action") == "NEW"
    first = met.where(new).groupBy(*key).agg(F.min(F.struct("ordinal", "successor_id")).alias("first"))
    met = met.join(first, key, "left")
    later = new & (F.col("ordinal") != F.col("first.ordinal"))
    return met.select(
        *judged.columns, F.when(later, "DUPLICATE").otherwise(F.col("action")).alias("action"), F.when(later, "EXACT_SCOPED_FINGERPRINT").otherwise(F.col("reason")).alias("reason"),
        F.when(later, F.col("first.successor_id")).otherwise(F.col("target")).alias("target"), F.when(new & ~later, F.col("successor_id")).when(later, F.lit("")).otherwise(F.col("successor")).alias("successor"),
    )


def process(proposed: DataFrame, records: DataFrame, projects: DataFrame, receipts: DataFrame, receipted: DataFrame, strict: bool = False) -> Processed:
    """Policy, decisions and commit of `proposed` against the store as it is, each operation once.

    `proposed`: operation_id, position (in its operation), ordinal (over the batch), stated (whether source or approval are given), and the
    columns of REQUEST and PROVENANCE. `records` as in `lifecycle_decisions`, with superseded_by. `receipts`: operation_id, request_hash,
    provenance_hash; `receipted`: the columns of DECISION.

    An operation with a receipt gives its stored decisions and changes nothing; one whose hashes differ from its receipt gives none, or
    fails the plan. An operation is receipted if none of its decisions was rejected, left to review or in conflict.
    """
    # contents are read once; what follows works on narrow tables
    proposed = cut(prepared(proposed).select("operation_id", "position", "ordinal", "stated", *[c for c in (*REQUEST, *PROVENANCE) if c != "content"], "unsafe", "request", "provenance"))
    records = cut(records.select(*RECORD))
    operations = cut(operation_states(proposed, receipts, strict))
    to_decide = operations.where("state = 'DECIDE'").select("operation_id")
    decided = cut(_decided(proposed.drop("request", "provenance").join(to_decide, "operation_id", "left_semi"), records, projects).select(*DECISION, "ordinal", "scope", "project_id", "claim_key", "fingerprint"))
    replayed = receipted.join(operations.where("state = 'REPLAY'"), "operation_id", "left_semi").select(*DECISION)
    own = decided.select(*DECISION)
    open_ = own.where(F.col("action").isin(*UNSETTLED)).select("operation_id").distinct()
    settled = operations.where("state = 'DECIDE'").join(open_, "operation_id", "left_anti").select("operation_id", "request_hash", "provenance_hash")
    # a new record may come under any id, so only what happens to stored records meets them by id
    effects = decided.where("action != 'NEW'").select("ordinal", "action", "target", "successor", "fingerprint", "scope", "project_id")
    return Processed(
        operations=operations.select("operation_id", "state"),
        decisions=own.unionByName(replayed),
        records=committed_records(records, decided, committed(records, effects)),
        receipts=receipts.select("operation_id", "request_hash", "provenance_hash").unionByName(settled),
        receipted=receipted.select(*DECISION).unionByName(own.join(settled.select("operation_id"), "operation_id", "left_semi")),
    )


def committed_records(records: DataFrame, decided: DataFrame, statuses: DataFrame) -> DataFrame:
    """The store after its decisions: records with their statuses, then what entered, with the candidate's fields, in the order of entry."""
    kept = records.select("memory_id", "store_ordinal", "scope", "project_id", "claim_key", "fingerprint").join(statuses, "memory_id")
    entered = decided.where(F.col("action").isin("NEW", "SUPERSEDE_EXISTING")).select(F.col("successor").alias("memory_id"), "ordinal", "scope", "project_id", "claim_key", "fingerprint", F.lit("active").alias("status"), F.lit("").alias("superseded_by"))
    last = F.coalesce(records.select(F.max("store_ordinal")).scalar(), F.lit(-1))
    return kept.select(*RECORD).unionByName(entered.withColumn("store_ordinal", last + 1 + F.col("ordinal")).select(*RECORD))


def merged_with_prior(validated: DataFrame, stored: DataFrame, aliases: DataFrame) -> DataFrame:
    """Validated candidates (candidate_id, aliases in order of preference, and the fields of a record) with what their stored form keeps:
    id, status, resolution, supersession, first timestamp; the rest is the candidate's. `stored` has one row per record, `aliases` (key,
    memory_id) its keys, of which the first record of a key counts."""
    first = aliases.groupBy("key").agg(F.min("memory_id").alias("prior_id"))
    asked = validated.select("candidate_id", F.posexplode("aliases").alias("place", "key"))
    taken = asked.join(first, "key").groupBy("candidate_id").agg(F.min(F.struct("place", "prior_id")).alias("x")).select("candidate_id", "x.prior_id")
    prior = stored.select(F.col("memory_id").alias("prior_id"), *[F.col(c).alias(f"prior_{c}") for c in ("status", "superseded_by", "at_s", "is_approved")])
    met = validated.join(taken, "candidate_id", "left").join(prior, "prior_id", "left")
    own = F.col("prior_id").isNotNull()
    carried = {"status": F.coalesce("prior_status", F.lit("active")), "superseded_by": F.coalesce("prior_superseded_by", F.lit("")), "at_s": F.coalesce("prior_at_s", "at_s"), "is_approved": F.coalesce("prior_is_approved", F.lit(False)) | F.col("is_approved")}
    return met.select("candidate_id", F.coalesce("prior_id", F.lit("")).alias("memory_id"), F.when(own, "kept").otherwise("new").alias("merge"), *[v.alias(k) for k, v in carried.items()], "content", "confidence")
