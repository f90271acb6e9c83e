"""Readers of the document formats: store documents, transcripts, daily notes, ledgers and hook payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "memory_id string, type string, content string, confidence double, quality_score double, novelty double, timestamp string, status string, superseded_by string, scope string, project_id string, is_approved boolean, source_id string"
DOCUMENT = f"schema_version int, revision long, validated_memory array<struct<{RECORD.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>"
HOOK = "event_type string, session_id string, project_root string, event_at string, transcript_path string, prompt string"
EVENT_TYPES = ("SESSION_START", "USER_PROMPT", "STOP", "SESSION_END")


def store_document(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON store documents in their order (store_ordinal); a broken document fails the read rather than being empty."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = docs.select("revision", F.posexplode("validated_memory").alias("store_ordinal", "r"))
    return each.select("revision", "store_ordinal", "r.*").withColumn("status", F.coalesce("status", F.lit("active")))


def transcript(spark: SparkSession, path: str, max_chars: int = 2_000_000) -> DataFrame:
    """(file, ordinal, role, content) of JSON-lines transcripts in either dialect; rows without role or content are left out.

    The ordinal is the row's place within its file, as Spark numbers the rows of a split; compare it within a file only.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value").where(F.length("value") <= max_chars)
    pick = lambda *paths: F.coalesce(*[F.get_json_object("value", p) for p in paths])
    role = F.lower(pick("$.role", "$.message.role", "$.payload.role", "$.type"))
    known = F.when(role.isin("human", "user"), "user").when(role.isin("assistant", "ai", "model"), "assistant").when(role == "system", "system")
    content = pick("$.message.content[0].text", "$.content[0].text", "$.payload.content[0].text", "$.message.content", "$.content", "$.text")
    kind = F.when(pick("$.isCompactSummary") == "true", "summary").when(pick("$.isMeta") == "true", "system").otherwise(known)
    return raw.select("file", "ordinal", kind.alias("role"), content.alias("content")).where("role is not null and content is not null")


def daily_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, day, content): the sections of Markdown files under '# Daily Notes - YYYY-MM-DD'."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    heading = r"(?m)^# Daily Notes - (\d{4}-\d{2}-\d{2})[ \t]*$"
    days, parts = F.regexp_extract_all("value", F.lit(heading), F.lit(1)), F.slice(F.split("value", heading), 2, 1_000_000)
    return whole.select("file", F.explode(F.arrays_zip(days.alias("day"), parts.alias("content"))).alias("x")).select("file", "x.day", F.trim(F.regexp_replace("x.content", r"^\s+|\s+$", "")).alias("content"))


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON-lines ledger; malformed lines are skipped."""
    return spark.read.schema("event_type string, session_id_hash string, project_id string, action string, attempt long, error_code string, at string").option("mode", "DROPMALFORMED").json(path)


def hook_events(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of `payloads` (value): untrusted JSON against a closed schema. An accepted event has an identity and, instead of
    its prompt, the prompt's hash and length."""
    seen = payloads.select("value", F.from_json("value", HOOK).alias("e"), F.json_object_keys("value").alias("keys"))
    allowed = [x.split()[0] for x in HOOK.split(", ")]
    reason = (
        F.when(F.col("keys").isNull(), "NOT_AN_OBJECT")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, allowed)))) > 0, "UNKNOWN_FIELD")
        .when(~F.coalesce(F.col("e.event_type").isin(*EVENT_TYPES), F.lit(False)), "EVENT_TYPE")
        .when(F.coalesce(F.length("e.session_id"), F.lit(0)).between(1, 200) == F.lit(False), "SESSION")
        .when(F.try_to_timestamp("e.event_at").isNull(), "EVENT_AT")
        .otherwise("")
    )
    rated = seen.withColumn("reason", reason)
    own = F.when(F.col("e.event_type") == "USER_PROMPT", F.concat_ws(":", F.lit("prompt"), "e.session_id", "e.event_at", F.sha2(F.coalesce("e.prompt", F.lit("")), 256))).otherwise(F.concat_ws(":", F.lit("session"), "e.session_id", F.lit("end")))
    accepted = rated.where("reason = ''").select(F.concat(F.lit("evt_"), F.substring(F.sha2(own, 256), 1, 26)).alias("event_id"), "e.event_type", "e.session_id", "e.project_root", F.try_to_timestamp("e.event_at").alias("event_at"), F.sha2("e.prompt", 256).alias("prompt_sha256"), F.length("e.prompt").alias("prompt_chars"))
    return accepted, rated.where("reason != ''").select("value", "reason")
