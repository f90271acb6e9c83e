"""PII: fixed forms of personal data, and the words that give a person away.

A term discloses an entity (an address, a number) when seeing the term makes the entity likely: the share of the documents with the term
that also hold the entity, and its ratio to the entity's own share of documents (pointwise mutual information). The share is smoothed
towards the entity's own share, so few documents weigh less, but none are left out. Terms over the upper threshold are removed, those over
the lower one generalised; both come out as spans of their own kinds, wherever the term stands in a document that holds the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, intake, small_broadcast
from .spans import SPAN, listed, replaced, running, spans_of

#: The forms, each written so that a search passes over a run of characters once (possessive, from the start of a run or
#: from where the last match ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9 -](?<![ -]{2})){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ANY = r"[@+]|[0-9]{2}|[0-9]\.[0-9]|[0-9][ -][0-9]"
TERM = r"(?<!\p{L})\p{L}{3,}+"

#: Documents that a term's share is smoothed with; shares from which it is removed or generalised; least PMI in bits. A term that only
#: one document has, with the entity, is generalised; one that two have, both with it, is removed.
PRIOR, REMOVE_FROM, GENERALISE_FROM, LEAST_BITS = 2, 0.5, 0.25, 3.0
#: Terms (or term and entity pairs) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(c: Column, k: Column) -> Column:
        d = c.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    single = F.filter(F.split(F.reverse(number), F.lit("")), lambda c: c != "")
    return F.aggregate(F.transform(single, worth), F.lit(0), lambda a, d: a + d) % 10 == 0


def personal(text: Column) -> Column:
    """The email, ip, card and phone spans of a text, sorted by start, then kind."""
    parts_fit = lambda s: F.forall(F.split(s["match"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    cards = F.filter(spans_of(text, CARD, 2, "card", F.lit("[ -]+$")), lambda s: F.when(F.length(digits(s["match"])).between(12, 19), luhn(digits(s["match"]))).otherwise(False))
    phones = F.filter(spans_of(text, PHONE, 3, "phone"), lambda s: F.length(digits(s["match"])).between(9, 15))
    return F.array_sort(F.concat(spans_of(text, EMAIL, 0, "email"), F.filter(spans_of(text, IP, 1, "ip"), parts_fit), cards, phones))


def lines_of(held: DataFrame) -> DataFrame:
    """The lines of the texts of `held`: doc_id, mark, at (code points before the line), line, base (spans within the line). No form
    crosses a line end, so a line's own spans are those of the text."""
    lines = held.select("doc_id", "mark", F.split("text", "\n").alias("lines"))
    placed = lines.select("doc_id", "mark", F.explode(F.arrays_zip("lines", F.slice(running(F.transform("lines", lambda x: F.length(x) + 1)), 1, F.size("lines")).alias("at"))).alias("x"))
    return placed.select("doc_id", "mark", F.col("x.at").alias("at"), F.col("x.lines").alias("line")).withColumn("base", own_spans(F.col("line")))


def own_spans(text: Column) -> Column:
    """`personal`, for the price of one search where nothing can match."""
    return F.when(text.rlike(ANY), personal(text)).otherwise(F.array().cast(SPAN))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def term_counts(docs: DataFrame, by_line: bool) -> tuple[DataFrame, int]:
    """(term, with_term): how many texts (`by_line`: lines) have each term; and how many texts there are."""
    corpus = intake(docs).select(F.explode(F.split("text", "\n")).alias("text")) if by_line else intake(docs).select("text")
    return cut_table(corpus.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))), corpus.count()


def common_terms(counts: DataFrame) -> DataFrame:
    """The commonest of `term_counts`, as many as may be broadcast, all from some power of two on."""
    power = F.floor(F.log2("with_term")).cast("int")
    sizes = {r["power"]: r["n"] for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    least = next((k for k in range(64) if sum(n for p, n in sizes.items() if p >= k) <= BROADCAST_ROWS), 64)
    return F.broadcast(counts.where(power >= least).withColumnRenamed("with_term", "known"))


def disclosing_terms(counts: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    """(entity, term, ord): the terms over a threshold, of those in `pairs` (a row per context, entity and term). All counts are exact."""
    together = cut(pairs.groupBy("entity", "term").agg(F.count("*").alias("together"), F.first("with_entity").alias("with_entity")))
    share = (F.col("together") + PRIOR * F.col("with_entity") / n) / (F.greatest("with_term", "together") + PRIOR)
    rated = counts.join(small_broadcast(together, BROADCAST_ROWS), "term").select("entity", "term", share.alias("share"), F.log2(share * n / F.col("with_entity")).alias("bits"))
    return rated.where((F.col("share") >= GENERALISE_FROM) & (F.col("bits") >= LEAST_BITS)).select("entity", "term", F.when(F.col("share") >= REMOVE_FROM, 5).otherwise(4).alias("ord"))


def disclosure_spans(docs: DataFrame, found: DataFrame, by_line: bool) -> DataFrame:
    """(doc_id, mark, more): the spans of disclosing terms in each text that has any, outside its personal data."""
    held = cut_table(found.where(F.size("base") > 0).select("doc_id", "mark", "text", "base"))
    lines = lines_of(held)
    units = lines.where(F.size("base") > 0).select("doc_id", "mark", F.col("at").alias("unit"), F.col("line").alias("text"), "base") if by_line else held.withColumn("unit", F.lit(0))
    key = ["doc_id", "mark", "unit"]
    as_ = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in key], *[c for c in df.columns if c not in key])
    same = lambda name: F.col("doc_id").eqNullSafe(F.col(f"{name}_doc_id")) & (F.col("mark") == F.col(f"{name}_mark")) & (F.col("unit") == F.col(f"{name}_unit"))
    nameless = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("kind")))
    named = F.array_distinct(F.transform("base", lambda s: F.concat_ws(" ", s["kind"], s["match"])))
    seen = cut_table(units.withColumn("bare", nameless).select(*key, named.alias("entities"), terms_of(replaced(F.col("text"), F.col("bare"))).alias("terms")))
    each = seen.select(*key, F.explode("entities").alias("entity"))
    per_entity = each.groupBy("entity").agg(F.count("*").alias("with_entity"))
    weighed = each.distinct().join(per_entity, "entity").groupBy(*key).agg(F.collect_list(F.struct("entity", "with_entity")).alias("entities"))
    counts, n = term_counts(docs, by_line)
    # A term that is too common to reach the lower threshold, even if it stood wherever the entity does, ends here, before any shuffle.
    every = seen.drop("entities").join(as_(weighed, "w"), same("w")).select(*key, "entities", F.explode("terms").alias("term")).join(common_terms(counts), "term", "left")
    reaches = F.col("known").isNull() | (F.col("e.with_entity") * (1 + PRIOR / n if n else 1) * (1 + 1e-9) >= GENERALISE_FROM * (F.col("known") + PRIOR))
    pairs = cut(every.select(*key, "term", "known", F.explode("entities").alias("e")).where(reaches).select(*key, "e.entity", "e.with_entity", "term"))
    guilty = cut(disclosing_terms(counts, n, pairs))
    # A term that several entities of the unit give away is removed if one of them asks for it.
    worst = pairs.join(small_broadcast(guilty, BROADCAST_ROWS), ["entity", "term"]).groupBy(*key, "term").agg(F.max("ord").alias("ord"))
    listed_ = worst.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "ord"))).alias("ords"))
    marked = lines.withColumn("unit", F.col("at") if by_line else F.lit(0)).join(as_(listed_, "g"), same("g"))
    outside = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    words = F.filter(spans_of(F.col("line"), TERM, 4, "term"), lambda w: F.map_contains_key("ords", F.lower(w["match"])) & outside(w))
    term = marked.select("doc_id", "mark", "at", "ords", F.explode(words).alias("w")).withColumn("ord", F.element_at("ords", F.lower("w.match")))
    kind = F.when(F.col("ord") == 5, "remove").otherwise("generalise")
    span = F.struct((F.col("at") + F.col("w.start")).cast("int").alias("start"), F.col("ord"), (F.col("at") + F.col("w.end")).cast("int").alias("end"), kind.alias("kind"), F.col("w.match").alias("match"))
    return term.select("doc_id", "mark", span.alias("s")).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("s")).alias("more"))


def find_personal_data(docs: DataFrame, by_line: bool = True) -> DataFrame:
    """Per row of `docs`: doc_id, text, `base` (email, ip, card, phone) and `found` (base and the disclosing terms), both `SPAN`, sorted.

    A null text is the empty text and has no spans; repeated rows give repeated results and count as documents; no rows give no rows.
    Co-occurrence is counted over all documents, a term against every entity of its document; `by_line`: over all lines, and terms are
    only marked in the lines where the entity stands.
    """
    text = F.col("text")
    found = intake(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text", own_spans(text).alias("base"))
    more = disclosure_spans(docs, found, by_line)
    same = (found.mark == more.mark) & found.doc_id.eqNullSafe(more.doc_id)
    both = found.join(small_broadcast(more, BROADCAST_ROWS), same, "left")
    return both.select(found.doc_id, "text", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("found"))


def sanitised(found: DataFrame) -> DataFrame:
    """doc_id and text, with each span of `found` replaced by its kind in brackets."""
    return found.select("doc_id", replaced(F.col("text"), F.col("found")).alias("text"))


def personal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_personal_data(docs, by_line=False).select("doc_id", *map(n, ("email", "ip", "card", "phone")), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_terms"))
