"""Spans of regular expressions in a text, as columns: code-point offsets, end exclusive, leftmost and non-overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,match:string>>"


def running(lengths: Column) -> Column:
    """0 and the running sums of an array of integers."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def spans_of(text: Column, pattern: str, ord_: int, kind: str, tail: Column | None = None) -> Column:
    """The matches of `pattern` in `text` as `SPAN`. What lies between matches is split off by the same pattern, so lengths add up to
    offsets. Texts without a match cost one search. `tail`: marks that end a match without being part of it, as a pattern."""
    between, found = F.split(text, F.lit(pattern), F.lit(-1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
    own = (lambda m: F.regexp_replace(m, tail, F.lit(""))) if tail is not None else (lambda m: m)
    ends = F.slice(running(steps), 2, F.size(found))
    spans = F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).cast("int").alias("start"), F.lit(ord_).alias("ord"), (end - F.length(m) + F.length(own(m))).cast("int").alias("end"), F.lit(kind).alias("kind"), own(m).alias("match")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def replaced(text: Column, spans: Column, by: Column | None = None) -> Column:
    """`text` with each of its sorted spans replaced by its kind in square brackets (spans that overlap an earlier one: left out)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        put = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= state["at"], F.struct(put.alias("out"), s["end"].alias("at"))).otherwise(state)

    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
