"""Retention of review items, trends of measurements, references from other projects, uses of delivered records, and forms of display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.lineage import cut

DAY = 86400
#: Days by which a review item is kept longer, the most from its creation, days of a trend, and the limits of references.
EXTEND_DAYS, MOST_DAYS, TREND_DAYS, POOL, REFERENCES = 7, 30, 7, 500, 3
REFERRED_TYPES = ("decision", "lesson")
#: The mark behind a text that was cut, words too common to tell a text, and the words that a use takes.
CUT_MARK = "\n… (bağlam kısaltıldı)"
COMMON = tuple(
    "this that with from have were will would should could there their about which when what then than "
    "into also only just more most such some each other these those they them been being over under after "
    "before because while where your ours ourselves bir için olarak olan daha çok gibi kadar sonra önce ancak "
    "fakat ama veya ile bunu şunu buna şuna bunun şunun artık hâlâ yani şimdi burada orada değil".split()
)
LEAST_WORDS, USE_SHARE = 3, 0.5
#: Words of delivered records that may be broadcast.
BROADCAST_WORDS = 1_000_000
MODES = ("OFF", "SHADOW", "CANARY", "ACTIVE")


def retention(items: DataFrame, as_of: int) -> DataFrame:
    """`items` (status, created_s, expires_s) with `expired`, and `extended_s`, until when an item may be kept longer; null if it is not
    waiting or was kept for the most days already."""
    waiting = F.col("status") == "PENDING"
    later = F.least(F.greatest("expires_s", F.lit(as_of)) + EXTEND_DAYS * DAY, F.col("created_s") + MOST_DAYS * DAY)
    return items.select("*", (waiting & (F.col("expires_s") <= as_of)).alias("expired"), F.when(waiting & (later > F.col("expires_s")), later).alias("extended_s"))


def measurement_trend(snapshots: DataFrame, as_of: int, days: int = TREND_DAYS) -> DataFrame:
    """One row over the snapshots (at_s, score, missing) of the last days: how many, the first and the last, whether the score fell below
    its best and whether more is missing than at first. No snapshots: zero, nulls and false."""
    recent = snapshots.where(F.col("at_s") >= as_of - days * DAY)
    found = recent.agg(
        F.count("*").alias("snapshots"), F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"), F.max("score").alias("best_score"),
        F.max_by("score", "at_s").alias("last_score"), F.min_by("missing", "at_s").alias("first_missing"), F.max_by("missing", "at_s").alias("last_missing"),
    )
    fell, grew = F.col("last_score") < F.col("best_score"), F.coalesce("last_missing", F.lit(0)) > F.coalesce("first_missing", F.lit(0))
    return found.select("*", F.coalesce(fell, F.lit(False)).alias("score_fell"), ((F.col("snapshots") >= 2) & grew).alias("missing_grew"))


def other_projects(records: DataFrame, vectors: DataFrame, asked: list[float], project: str, private: list[str]) -> DataFrame:
    """memory_id, project_id, similarity: of the newest `POOL` active decisions and lessons of other projects that are not private, the
    `REFERENCES` nearest to a vector. The pool is taken first, so vectors are read for its rows only."""
    eligible = records.where((F.col("status") == "active") & F.col("type").isin(*REFERRED_TYPES) & (F.col("project_id") != "") & (F.col("project_id") != project) & F.col("is_approved"))
    if private:
        eligible = eligible.where(~F.col("project_id").isin(*private))
    pool = eligible.select("memory_id", "store_ordinal", "project_id", "at_s").orderBy(F.desc("at_s"), "store_ordinal").limit(POOL)
    against = F.array(*[F.lit(float(x)) for x in asked])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    v = F.col("embedding")
    norm = F.sqrt(dot(v, F.transform(v, lambda x: x.cast("double")))) * F.sqrt(dot(against, against))
    scored = pool.join(vectors, F.col("store_ordinal") == F.col("vec_id")).select("memory_id", "store_ordinal", "project_id", F.round(F.when(norm > 0, dot(v, against) / norm).otherwise(0.0), 9).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "store_ordinal").limit(REFERENCES).select("memory_id", "project_id", "similarity")


def distinctive_words(content: Column) -> Column:
    """The different words of at least four letters that are not common ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_-]{3,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, COMMON)))


def used_records(delivered: DataFrame, records: DataFrame, turns: DataFrame) -> DataFrame:
    """(session, memory_id): delivered records half of whose distinctive words, three at least, an assistant's turn of the session holds.

    A session's replies are gathered as hashes of its different words, a record's words likewise, and only pairs of a delivery meet: neither
    a delivery's words nor matches of single words are rows. The delivered records go to all tasks if their words are few.
    """
    hashed = F.transform(distinctive_words(F.coalesce("content", F.lit(""))), lambda w: F.xxhash64(w))
    said = turns.where("role = 'assistant'").select("session", F.explode(hashed).alias("word")).groupBy("session").agg(F.collect_set("word").alias("said"))
    asked = delivered.select("session", "memory_id").distinct()
    words = cut(records.join(asked.select("memory_id").distinct(), "memory_id", "left_semi").select("memory_id", hashed.alias("words")).where(F.size("words") >= LEAST_WORDS))
    few = (words.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_WORDS
    met = asked.join(F.broadcast(words) if few else words, "memory_id").join(said, "session")
    return met.where(F.size(F.array_intersect("words", "said")) >= USE_SHARE * F.size("words")).select("session", "memory_id")


def fitted(content: Column, limit: int) -> Column:
    """A content, cut behind a whole line if it is longer than `limit`, with a mark; one line that is too long is cut inside."""
    head = F.substring(content, 1, limit - len(CUT_MARK))
    whole = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    return F.when(F.length(content) <= limit, content).otherwise(F.concat(F.when(whole > 0, F.left(head, whole)).otherwise(head), F.lit(CUT_MARK)))


def display_form(content: Column, limit: int = 80) -> Column:
    x = F.regexp_replace(F.replace(content, F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit("...")))


def record_date(source_id: Column, at_s: Column) -> Column:
    """The day that a source id names in its second part, else the day of the record's time, UTC."""
    named = F.get(F.split(source_id, ":"), F.lit(1))
    return F.when(named.rlike(r"^\d{4}-\d{2}-\d{2}$"), named).otherwise(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at_s / DAY).cast("int")), "yyyy-MM-dd"))


def accept_allowed(mode: Column, shadow_accept: Column, approved: Column) -> Column:
    """Whether one effect may reach the store: always in CANARY and ACTIVE, in SHADOW if a person approved it and that is switched on."""
    return mode.isin("CANARY", "ACTIVE") | ((mode == "SHADOW") & approved & shadow_accept)


def last_events(events: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` latest events (at_s, ordinal) of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at_s"), F.desc("ordinal")))
    return events.withColumn("place", place).where(F.col("place") <= most).drop("place")


def projection_state(source_revision: Column, revision: Column) -> Column:
    """missing without a source revision, source_unavailable without a current one, else fresh or stale."""
    return F.when(source_revision.isNull(), "missing").when(revision.isNull(), "source_unavailable").when(source_revision == revision, "fresh").otherwise("stale")


def content_key(content: Column) -> Column:
    """The key of a cached vector: a hash of the content with single spaces, letters' case kept."""
    return F.sha2(F.trim(F.regexp_replace(content, r"\s+", " ")), 256)


def json_text(x: Column) -> Column:
    """A string as JSON text, null as null."""
    whole = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNull(), "null").otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


def review_fingerprint(fields: dict[str, Column]) -> Column:
    """The identity of a candidate: a hash of its fields as a JSON object, by name."""
    parts = [F.concat(F.lit(f'"{name}": '), json_text(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("fp_"), F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256))
