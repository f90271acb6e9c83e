"""The engine's tables as deterministic projections of the Parquet tables: memory records, evidence, ledger and so on.

Every view is a narrow lazy DataFrame, so filters and column selection reach the Parquet scan. Nothing reads a clock: `AS_OF` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-02-01 00:00:00 UTC, in seconds; and the moment of the burst, ten days before.
AS_OF, BURST_AT = 1706745600, 1705881600

#: The phrases that end statements, and short approvals.
PHRASES = (
    "We decided to use PostgreSQL in phase 3.", "We will use Redis for the cache.", "Should we use Docker?", "Maybe we could move to React.",
    "The build is failing right now.", "The deploy blocker was resolved.", "We learned that pytest is enough.", "I prefer Python scripts.",
    "no, that is wrong", "Everything must be tested before release.", "Phase 7 is in progress.", "don't use FastAPI for this",
    "use FastAPI for this", "see docs/plan.md and src/app.py", "tamam", "Nothing notable today.",
)
AFFIRMATIONS = ("tamam", "evet", "ok", "yes")
NOVEL_WORDS = ("new", "discovered", "realized", "learned", "changed", "decided", "pivoted")
ACTIONS = {"signup": "ENQUEUED", "view": "CLAIMED", "click": "PROCESSING", "purchase": "COMMITTED", "error": "DEAD_LETTER"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], at: Column) -> Column:
    """The value at a position from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def memory_id(number: Column) -> Column:
    return F.concat(F.lit("mem_"), F.lpad(number.cast("string"), 8, "0"))


def novelty(content: Column) -> Column:
    low = F.lower(content)
    found = F.lit(False)
    for w in NOVEL_WORDS:
        found = found | low.contains(w)
    return F.when(found, 0.9).otherwise(0.5)


def _records(docs: DataFrame, labels: DataFrame, content: Column) -> DataFrame:
    n, chars = F.col("doc_id"), F.col("n_chars")
    at = F.when(n % 25 == 0, BURST_AT).otherwise(AS_OF - (n % 45) * 86400 - (n % 1440) * 60).cast("long")
    scope = F.when(chars % 3 == 0, "global").otherwise("project")
    own = docs.join(labels, "doc_id", "left")
    return own.select(
        memory_id(n).alias("memory_id"), n.alias("store_ordinal"),
        F.when(chars % 4 == 0, "decision").when(chars % 4 == 1, "lesson").when(chars % 4 == 2, "open_loop").otherwise("observation").alias("type"),
        content.alias("content"), ((n * 37 % 100) / 100).alias("confidence"),
        F.when(F.col("quality").isNotNull(), F.col("quality") * F.lit(0.5) + F.lit(0.4)).otherwise((n * 53 % 100) / 100).alias("quality_score"),
        novelty(content).alias("novelty"), at.alias("at_s"),
        F.when(n % 10 == 8, "resolved").when(n % 10 == 9, "superseded").otherwise("active").alias("status"),
        F.when(n % 50 == 49, "mem_99999999").when(n % 10 == 9, memory_id(n - 1)).otherwise("").alias("superseded_by"),
        scope.alias("scope"), F.when(chars % 3 == 0, "").otherwise(F.concat(F.lit("p_"), F.col("lang"))).alias("project_id"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("is_approved"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory records over whole texts."""
    return _records(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.coalesce(F.col("text"), F.lit("")))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that say something: a text and one of the phrases."""
    content = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(" "), pick(PHRASES, F.col("doc_id") % len(PHRASES)))
    return _records(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), content)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: session, ordinal, role, content. Some user turns only approve what the assistant just said."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(order))
    approves = (F.col("role") == "user") & (F.col("before") == "assistant") & (F.col("conv_id") % 3 == 0)
    content = F.when(approves, pick(AFFIRMATIONS, F.col("conv_id") % 4)).when(F.col("role") == "assistant", F.concat("text", F.lit(" "), pick(PHRASES, (F.col("conv_id") + F.col("turn")) % 16))).otherwise(F.col("text"))
    return turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "role", content.alias("content"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture events: ordinal, session, job, action, attempt, at."""
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return e.select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("session"), (F.col("event_id") % 997).alias("job"), F.element_at(kinds, F.col("event_type")).alias("action"), (F.get_json_object("props", "$.k").cast("long") % 3 + 1).alias("attempt"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which memory was delivered to which session, and when."""
    e = table(spark, sf_dir, "events")
    return e.select(memory_id(F.col("event_id") % 199).alias("memory_id"), F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per language: project_id, root, status, proactive_capture."""
    lang = table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct()
    return lang.select(F.concat(F.lit("p_"), "lang").alias("project_id"), F.concat(F.lit("/work/"), "lang").alias("root"), F.when(F.col("lang") == "es", "archived").otherwise("active").alias("status"), (F.col("lang") != "fr").alias("proactive_capture"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals: benchmark passages and one statement in seven, which collide with memories on purpose."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("candidate_id"), F.lit("lesson").alias("type"), F.col("text").alias("content"), F.lit("global").alias("scope"), F.lit("").alias("project_id"), F.lit("COMMITTED").alias("commitment"), (F.col("item_id") % 5 != 0).alias("approved"), F.lit(0.8).alias("confidence"), F.lit(AS_OF).cast("long").alias("created"))
    s = statements(spark, sf_dir).where(F.col("store_ordinal") % 7 == 0)
    own = s.select(F.concat(F.lit("cand_"), F.col("store_ordinal").cast("string")).alias("candidate_id"), "type", "content", "scope", "project_id", F.when(F.col("store_ordinal") % 3 == 0, "OBSERVED").otherwise("COMMITTED").alias("commitment"), F.col("is_approved").alias("approved"), "confidence", F.col("at_s").alias("created"))
    return b.unionByName(own)


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_records(content: str) -> str:
    novel = " OR ".join(f"contains(lower({content}), '{w}')" for w in NOVEL_WORDS)
    return f"""SELECT 'mem_' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS memory_id, d.doc_id AS store_ordinal,
  CASE d.n_chars % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'lesson' WHEN 2 THEN 'open_loop' ELSE 'observation' END AS type,
  {content} AS content, CAST(d.doc_id * 37 % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN l.quality IS NOT NULL THEN l.quality * CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) ELSE CAST(d.doc_id * 53 % 100 AS DOUBLE) / 100 END AS quality_score,
  CASE WHEN {novel} THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS novelty,
  CASE WHEN d.doc_id % 25 = 0 THEN {BURST_AT} ELSE {AS_OF} - (d.doc_id % 45) * 86400 - (d.doc_id % 1440) * 60 END AS at_s,
  CASE d.doc_id % 10 WHEN 8 THEN 'resolved' WHEN 9 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN d.doc_id % 50 = 49 THEN 'mem_99999999' WHEN d.doc_id % 10 = 9 THEN 'mem_' || lpad(CAST(d.doc_id - 1 AS VARCHAR), 8, '0') ELSE '' END AS superseded_by,
  CASE WHEN d.n_chars % 3 = 0 THEN 'global' ELSE 'project' END AS scope,
  CASE WHEN d.n_chars % 3 = 0 THEN '' ELSE 'p_' || d.lang END AS project_id, coalesce(l.toxic, 0) = 0 AS is_approved
FROM documents d LEFT JOIN labels l USING (doc_id)"""


_PHRASE = f"{_sql_list(PHRASES)}[CAST(%s AS INTEGER) + 1]"
#: The same views for the oracle, by name; `with_views` puts together those that a query needs.
SQL = {
    "memories": _sql_records("coalesce(d.text, '')"),
    "statements": _sql_records(f"(coalesce(d.text, '') || ' ' || {_PHRASE % 'd.doc_id % 16'})"),
    "evidence": f"""SELECT conv_id AS session, turn AS ordinal, role,
  CASE WHEN role = 'user' AND before = 'assistant' AND conv_id % 3 = 0 THEN {_sql_list(AFFIRMATIONS)}[CAST(conv_id % 4 AS INTEGER) + 1]
       WHEN role = 'assistant' THEN text || ' ' || {_PHRASE % '(conv_id + turn) % 16'} ELSE text END AS content
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""",
    "ledger": "SELECT event_id AS ordinal, user_id AS session, event_id % 997 AS job, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END AS action, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1 AS attempt, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events",
    "deliveries": "SELECT 'mem_' || lpad(CAST(event_id % 199 AS VARCHAR), 8, '0') AS memory_id, user_id AS session, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events",
    "projects": "SELECT DISTINCT 'p_' || lang AS project_id, '/work/' || lang AS root, CASE WHEN lang = 'es' THEN 'archived' ELSE 'active' END AS status, lang <> 'fr' AS proactive_capture FROM documents WHERE lang IS NOT NULL",
    "candidates": f"""SELECT 'bench_' || CAST(item_id AS VARCHAR) AS candidate_id, 'lesson' AS type, text AS content, 'global' AS scope, '' AS project_id, 'COMMITTED' AS commitment, item_id % 5 <> 0 AS approved, CAST(0.8 AS DOUBLE) AS confidence, CAST({AS_OF} AS BIGINT) AS created FROM benchmark
UNION ALL SELECT 'cand_' || CAST(store_ordinal AS VARCHAR), type, content, scope, project_id, CASE WHEN store_ordinal % 3 = 0 THEN 'OBSERVED' ELSE 'COMMITTED' END, is_approved, confidence, at_s FROM statements WHERE store_ordinal % 7 = 0""",
}
_NEEDS = {"candidates": ("statements",)}


def with_views(*names: str) -> str:
    """WITH ... of the named views and those they need, to be followed by further CTEs or a SELECT."""
    every = dict.fromkeys(x for n in names for x in (*_NEEDS.get(n, ()), n))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in every)
