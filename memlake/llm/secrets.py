"""Secret scans: fixed credential forms, and runs of characters that look random to two character Markov models.

One model learns random strings, the other ordinary identifiers; a run's mean log-likelihood ratio per transition decides. Everything is
a projection of the text; the models are one array of fixed size.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, intake
from .spans import SPAN, listed, spans_of

#: The credential forms. Minimum lengths are part of the last two; the first is filtered by its second group.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs that the models judge: whole runs, so a search passes over each character once.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
LEAST_VALUE = 12

#: The models' states; any other character is state 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: A run counts as random if its log-likelihood ratio, in nats, passes so much per transition, and so much besides: a short run must be the
#: clearer. A card number, whose digits are rare in words and nothing more, stays below it up to its 19 digits.
THRESHOLD, BESIDES = 0.9, 12.0
#: Labelled samples: so many random strings of each form, and the words of so many documents.
RANDOM_STRINGS, WORD_DOCUMENTS = 2000, 1000


def codes(text: Column) -> Column:
    """The states of a string's characters."""
    return F.transform(F.filter(F.split(text, F.lit("")), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))


def labelled_samples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(text, label): hexadecimal, base-64 and capital random strings (1), made from SHA-256 of a counter; words and joined words (0) of
    about `WORD_DOCUMENTS` documents."""
    digest = spark.range(RANDOM_STRINGS).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    forms = F.array("h", F.substring(F.base64(F.unhex("h")), 1, 40), F.translate(F.upper(F.substring(F.base64(F.unhex("h")), 1, 24)), "+/=", "7Q3"))
    random = digest.select(F.explode(forms).alias("text"), F.lit(1).alias("label"))
    chosen = hash_sample(intake(docs), WORD_DOCUMENTS, "doc_id", "text")
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= 3)
    joined = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws("_", F.element_at("w", i), F.element_at("w", i + 1)))
    plain = chosen.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.concat("w", joined)).alias("text"), F.lit(0).alias("label"))
    return random.union(plain)


def fixed_array(values: Sequence[float]) -> Column:
    """A literal array of doubles."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


def markov_ratios(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition (random against ordinary) as a list of STATES * STATES, row by
    row of the state before. Null texts and texts of one character teach nothing; labels other than 1 count as 0."""
    seen = samples.where("text is not null").select(codes(F.col("text")).alias("c"), (F.col("label") == 1).alias("random")).where(F.size("c") > 1)
    steps = seen.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * STATES + b)).alias("step"))
    counts = steps.groupBy("step").agg(F.count_if("random").alias("r"), F.count_if(~F.coalesce("random", F.lit(False))).alias("o"))
    grid = samples.sparkSession.range(STATES * STATES).withColumnRenamed("id", "step").join(counts, "step", "left").fillna(0)
    rows = grid.groupBy(F.floor(F.col("step") / STATES).alias("before")).agg(F.sum("r").alias("rs"), F.sum("o").alias("os"), F.sort_array(F.collect_list(F.struct("step", "r", "o"))).alias("own"))
    smooth = lambda n, total: (n + smoothing) / (total + smoothing * STATES)
    ratio = rows.select("before", F.transform("own", lambda x: F.log(smooth(x["r"], F.col("rs"))) - F.log(smooth(x["o"], F.col("os")))).alias("ratios"))
    return ratio.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("before", "ratios"))), lambda x: x["ratios"])).alias("ratios")).first()["ratios"]


def mean_ratio(run: Column, ratios: Column) -> Column:
    """The mean log-likelihood ratio of a run's transitions."""
    c = codes(run)
    total = F.aggregate(
        c,
        F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct(x.alias("before"), F.when(s["before"] < 0, 0.0).otherwise(s["sum"] + F.element_at(ratios, s["before"] * STATES + x + 1)).alias("sum")),
    )
    return total["sum"] / F.greatest(F.length(run) - 1, F.lit(1))


def find_secrets(docs: DataFrame, ratios: Sequence[float], threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, text, `base` and `found` (`SPAN`, sorted by start, then kind): base has the fixed forms (assign, access,
    hex); found also the runs of 16 characters and more, of kind markov, that overlap none of them and that the models call random.

    A null text is the empty text; rows are independent, so repeated rows give repeated results; no rows give no rows. Texts of any length
    are searched whole. Other columns are left behind.
    """
    text = F.col("text")
    assign = F.when(text.rlike(ASSIGN), F.transform(F.filter(F.zip_with(spans_of(text, ASSIGN, 0, "assign"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.length(x["v"]) >= LEAST_VALUE), lambda x: x["s"])).otherwise(F.array().cast(SPAN))
    based = intake(docs).select("doc_id", "text", F.array_sort(F.concat(assign, spans_of(text, ACCESS, 1, "access"), spans_of(text, HEX, 2, "hex"))).alias("base"))
    table = fixed_array(ratios)
    scored = based.select("*", spans_of(text, RUN, 3, "markov").alias("runs")).select("*", F.filter("runs", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))).alias("open"))
    random = F.when(F.size("open") > 0, F.filter("open", lambda s: mean_ratio(s["match"], table) >= threshold + BESIDES / F.length(s["match"]))).otherwise(F.array().cast(SPAN))
    return scored.select("doc_id", "text", "base", F.array_sort(F.concat("base", random)).alias("found"))


def secrets_digest(docs: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: `find_secrets` as counts and one list, with its defined cases."""
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs, ratios).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), n("markov"))
