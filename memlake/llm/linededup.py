"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its words. Equal sets are one class from the start, represented by the first line. The words of a class are ordered
by rarity. Two sets that reach the threshold share one of their first words that is rare, or else one of the first links of frequent words,
the pairs that follow each other in the order (`signatures`). Rare words bring few lines together whatever the corpus, and links are far
rarer than frequent words, so most entries end as soon as they are counted. What is left passes length and positional filters and a
comparison of 128-bit sketches inside the join, then the exact comparison. Each signature first meets the earliest line with it; only lines that
no earliest line removes meet the others, so a group of thousands of variants of one line stays linear as long as they resemble its first.

Splitting, hashing and sorting words is numpy work inside tasks; the joins, counts and decisions are Spark's. (The forms without Python,
of which the README gives the figures, did not meet the limits.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, mixed, small_broadcast

#: Similarity as a fraction, so that thresholds are exact integers.
NUMERATOR, DENOMINATOR = 4, 5
#: Sets of fewer words reach the threshold with equal sets only.
LINKED = 4
#: Words are counted by hash buckets, about one for 128 bytes of text, within these bits: any order of buckets and any choice of rare ones is
#: right, they only decide how much meets.
BUCKET_BITS = (16, 24)
#: Rarity ranks: 2 log2 (n + 1) of the words in a bucket; one of a single word, and the highest of a rare one (21 words).
ONCE, RARE = 2, 8
#: Bucket counts that a task holds before it writes them.
COUNTED = 4_000_000
#: Characters that are looked at together; a longer line is looked at alone.
TOGETHER = 1 << 20
#: Lines of a signature from which on a pair of lines ends unless it is their least common one of such signatures.
LARGE = 16
#: What may be broadcast: rows of a few numbers, items of lists.
PAIR_ROWS, LIST_ITEMS = 1_000_000, 2_000_000

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 32]] = True
LETTERS = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
FAR = np.uint64(0xD1342543DE82EF95)


def numbered(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(number, doc_id, text) and, if there are other columns, `rest`, a struct of them; the bits that a line number may take, and those for
    buckets of words.
    Numbers are in the order of doc_id and free of repeats.

    The number is the doc_id itself, if all are there, different and small enough to leave these bits. Else it is the place of (doc_id,
    hash of the text) in their order: nulls first, repeated rows once.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.struct(*rest).alias("rest") for _ in rest[:1]))
    rest = own.columns[2:]
    each = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("longest"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    seen = each.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("n").alias("n"), F.max("longest").alias("longest"), F.sum("size").alias("size"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bits = max(1, int(seen["longest"] or 0).bit_length())
    spread = min(max(int(seen["size"] or 0).bit_length() - 7, BUCKET_BITS[0]), BUCKET_BITS[1])
    if not seen["nulls"] and seen["n"] in (None, 1) and (seen["low"] or 0) >= 0 and (seen["high"] or 0) < 1 << (63 - bits):
        return own.select(F.col("doc_id").alias("number"), "doc_id", "text", *rest), bits, spread
    marked = own.select("doc_id", F.xxhash64("text").alias("mark"), "text", *rest).dropDuplicates(["doc_id", "mark"])
    placed = cut(marked.select("doc_id", "mark").orderBy(F.asc_nulls_first("doc_id"), "mark").select("*", F.monotonically_increasing_id().alias("place")))
    share, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    widest = (placed.agg(F.max(at)).first()[0] or 0) + 1
    numbers = placed.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), (share * widest + at).alias("number"))
    return marked.join(numbers, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("number", "doc_id", "text", *rest), bits, spread


def pieces(numbers: list[int], texts: list[str], bits: int) -> Iterator[tuple[list[int], list[str]]]:
    """Whole lines of about `TOGETHER` characters: the ids of their first lines, and the lines."""
    ids: list[int] = []
    parts: list[str] = []
    size = 0
    for number, text in zip(numbers, texts, strict=True):
        line, at = number << bits, 0
        while at >= 0:
            end = text.find("\n", at + TOGETHER) if len(text) - at > TOGETHER else -1
            part = text[at:] if end < 0 else text[at:end]
            ids.append(line)
            parts.append(part)
            size += len(part)
            if size > TOGETHER:
                yield ids, parts
                ids, parts, size = [], [], 0
            if end >= 0:
                line += part.count("\n") + 1
            at = end + 1 if end >= 0 else -1
    if parts:
        yield ids, parts


def line_words(ids: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, id): the words' 64-bit hashes with the places of their lines, in order, and the ids of all lines."""
    raw = np.frombuffer("\n".join(parts).lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.array([p.count("\n") + 1 for p in parts])
    ends = np.cumsum(counts)
    line_ids = np.arange(ends[-1]) + np.repeat(np.array(ids, np.int64) - (ends - counts), counts)
    apart = SEPARATORS[raw]
    edges = np.flatnonzero(np.diff(apart.view(np.int8), prepend=1, append=1))
    starts = edges[::2]
    lengths = edges[1::2] - starts
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), line_ids
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(offsets, lengths)
    values = LETTERS[raw[~apart]] * POWERS[at & 0xFFFF]
    if lengths.max() > 1 << 16:
        values *= FAR ** (at >> 16).astype(np.uint64)
    return np.searchsorted(np.flatnonzero(raw == 10), starts), mixed(np.add.reduceat(values, offsets)), line_ids


def word_sets(place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, start, n, line): each line's different words, sorted by key, one line after the other."""
    order = np.lexsort((key, place))
    place, key = place[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1])
    place, key = place[new], key[new]
    start = np.flatnonzero(np.diff(place, prepend=-1))
    return key, start, np.diff(start, append=len(key)), place[start]


def signatures(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, size): what sets of n words that begin at `start` meet others by: their rare words and, of size 2, their links of frequent
    words, two that follow each other. `key` holds the words from the rarest on, the rarity rank in the upper 8 bits.

    Let two sets that reach the threshold share o words, and a and b be those that only one of them has: o >= 4 (a + b), so 5 a + 4 b <= n.
    If the rarest shared word is a rare one, no more than a <= n / 5 words of the set come before it. Else all r rare words are among the
    a. Of the n - r - 1 links of the rest, o - 1 - (a - r) - b at least are shared, as each of the other words parts one pair of shared ones at
    most; so a shared one is among the first 2 a + b - 2 r + 1 <= 2 n / 5 - 2 r + 1. A word that occurs once meets none.
    """
    place = np.arange(len(key)) - np.repeat(start, n)
    rank = (key >> np.uint64(56)).astype(np.int64)
    r = np.add.reduceat((rank <= RARE).astype(np.int64), start)
    of = lambda each: np.repeat(each, n)
    alone = (rank > ONCE) & (rank <= RARE) & (place <= of(n // 5))
    count = np.where(5 * r <= n, np.minimum(2 * n // 5 - 2 * r + 1, n - r - 1), 0)
    linked = (place >= of(r)) & (place < of(r + count))
    size = alone + 2 * linked
    found = np.flatnonzero(size)
    return of(np.arange(len(n)))[found], place[found], size[found]


MARKS = "id long, h long, g long"
Batches = Iterator[pa.RecordBatch]


def marks(own: DataFrame, bits: int, spread: int) -> DataFrame:
    """A row per line that has words (`MARKS`): its id and two hashes of its set; and rows without an id, h being one of 2 ** `spread` buckets
    of words and g how many words of the task fall into it."""

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "h", "g"])

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        seen, at = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(seen)).astype(np.int64)
        return rows([None] * len(seen), seen, counts)

    def look(batches: Batches) -> Batches:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for ids, texts in pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bits):
                place, h, line_ids = line_words(ids, texts)
                if not len(h):
                    continue
                parts.append(np.unique((h >> np.uint64(64 - spread)).astype(np.int64), return_counts=True))
                key, start, _, line = word_sets(place, h)
                yield rows(line_ids[line], np.add.reduceat(mixed(key), start).view(np.int64), np.add.reduceat(mixed(key ^ FAR), start).view(np.int64))
            if sum(len(s) for s, _ in parts) > COUNTED:
                yield counted(parts)
                parts = []
        if parts:
            yield counted(parts)

    return own.select("number", "text").mapInArrow(look, MARKS)


def rarity(marked: DataFrame, spread: int) -> tuple[np.ndarray, int]:
    """The rarity rank of each bucket of words, and how many words there are. Of a bucket with more than one word, one number reaches the
    driver."""
    counts = cut_table(marked.where("id is null").groupBy("h").agg(F.sum("g").alias("n")).where("n > 1"))
    words = counts.agg(F.sum("n")).first()[0] or 0
    rank = F.least(F.lit(126), F.floor(2 * F.log2(F.col("n") + 1)))
    packed = counts.select((F.shiftleft("h", 8) + rank).alias("x")).toArrow().column("x").to_numpy()
    ranks = np.full(1 << spread, ONCE, np.uint8)
    ranks[packed >> 8] = packed & 255
    return ranks, words


def entries(own: DataFrame, bits: int, ranks: np.ndarray, words: int) -> DataFrame:
    """(id, bits, more, t, at): for each line of at least `LINKED` different words that may meet another a sketch of its set, of which each word
    flips one of 128 bits, and by items of the lists its `signatures` as hashes, and n << 32 | place. The hashes have as many bits as tell so
    many words apart: what meets by chance is sorted out later, and short hashes shuffle cheaply."""
    spare = np.uint64(max(1, 64 - int(words).bit_length() - 7))
    shift = np.uint64(64 - (len(ranks).bit_length() - 1))

    def look(batches: Batches) -> Batches:
        for batch in batches:
            for ids, texts in pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bits):
                place, h, line_ids = line_words(ids, texts)
                if not len(h):
                    continue
                key, start, n, line = word_sets(place, ranks[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8))
                bit, upper = np.uint64(1) << (key & np.uint64(63)), key & np.uint64(64) != 0
                sketch = [np.bitwise_xor.reduceat(np.where(there, bit, np.uint64(0)), start) for there in (~upper, upper)]
                which, at, size = signatures(key, start, n)
                wide = n[which] >= LINKED
                which, at, size = which[wide], at[wide], size[wide]
                if not len(which):
                    continue
                first = start[which] + at
                follows = np.where(size > 1, mixed(key[np.minimum(first + 1, len(key) - 1)] ^ FAR), np.uint64(0))
                t = mixed(key[first] + follows) >> spare
                kept, offsets = np.unique(which, return_index=True)
                offsets = pa.array(np.append(offsets, len(which)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (t.view(np.int64), n[which] << 32 | at)]
                yield pa.RecordBatch.from_arrays([pa.array(line_ids[line[kept]]), *(pa.array(x[kept].view(np.int64)) for x in sketch), *lists], names=["id", "bits", "more", "t", "at"])

    return own.select("number", "text").mapInArrow(look, "id long, bits long, more long, t array<long>, at array<long>")


def least_shared(n: Column, m: Column) -> Column:
    """Words that sets of n and m words share at least if they reach the threshold."""
    return F.ceil((n + m) * (NUMERATOR / (NUMERATOR + DENOMINATOR)) - 1e-9)


def may_reach(a: str, b: str) -> Column:
    """Length and positional filters, and that of the sketches, for two lines with a signature in common: `a` and `b` begin the names of n <<
    32 | place of it and of the sketch."""
    (x, y), (bits, more) = (F.col(f"{side}_at") for side in (a, b)), (F.bit_count(F.col(f"{a}_{half}").bitwiseXOR(F.col(f"{b}_{half}"))) for half in ("bits", "more"))
    n, m, i, j = (F.shiftright(x, 32), F.shiftright(y, 32), x.bitwiseAND(0xFFFFFFFF), y.bitwiseAND(0xFFFFFFFF))
    lengths = DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)
    return lengths & (F.least(i, j) + F.least(n - i, m - j) >= least_shared(n, m)) & (bits + more <= n + m - 2 * least_shared(n, m))


def chosen_sets(own: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """(id, words): the different words' hashes of the lines `ids` (id). Only documents that hold such lines are split again."""
    asked = ids.groupBy(F.shiftright("id", bits).alias("holder")).agg(F.collect_list(F.col("id")).alias("asked"))
    held = own.select("number", "text").join(small_broadcast(cut(asked), LIST_ITEMS, "asked"), F.col("number") == F.col("holder")).select("number", "text", "asked")

    def look(batches: Batches) -> Batches:
        for batch in batches:
            for k, wanted in enumerate(batch.column(2)):
                one = batch.slice(k, 1)
                for ids, parts in pieces(one.column(0).to_pylist(), one.column(1).to_pylist(), bits):
                    place, h, line_ids = line_words(ids, parts)
                    asked_here = np.isin(line_ids, wanted.values.to_numpy())
                    keep = asked_here[place] if len(h) else np.empty(0, bool)
                    if keep.any():
                        key, start, _, line = word_sets(place[keep], h[keep])
                        yield pa.RecordBatch.from_arrays([pa.array(line_ids[line]), pa.ListArray.from_arrays(np.append(start, len(key)).astype(np.int32), pa.array(key.view(np.int64)))], names=["id", "words"])

    return held.mapInArrow(look, "id long, words array<long>")


def similar_pairs(near: DataFrame, own: DataFrame, bits: int) -> DataFrame:
    """Those of `near` (late, early), which is cut, whose lines reach the threshold, by the hashes of all their words."""
    asked = near.select(F.col("late").alias("id")).union(near.select("early")).distinct()
    words = cut_table(chosen_sets(own, asked, bits))
    known = near.join(words.select(F.col("id").alias("late"), F.col("words").alias("x")), "late").join(words.select(F.col("id").alias("early"), F.col("words").alias("y")), "early")
    sized = known.select("late", "early", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return sized.where(DENOMINATOR * F.col("both") >= NUMERATOR * (F.col("n") - F.col("both"))).select("late", "early")


def side(lines: DataFrame, name: str) -> DataFrame:
    """Rows (t, id, at, bits, more) of lines with their signatures as one side of a join, whose columns begin with `name`."""
    return lines.select("t", F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in lines.columns if c in ("at", "bits", "more", "ts")))


def meeting_pairs(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """(late, early): the lines of `groups` (t, id, at, bits, more, lines) that are not `removed` (id) with the earlier ones that they share a
    signature with and `may_reach`. Lines of a large signature share many of them; a pair of such lines is a row for one of these only."""
    large = groups.where(F.col("lines") > LARGE)
    large = large.join(large.groupBy("id").agg(F.collect_set("t").alias("ts")), "id")
    near = (F.col("early") < F.col("late")) & may_reach("late", "early")
    least = F.array_min(F.array_intersect("late_ts", "early_ts")) == F.col("t")

    def met(among: DataFrame, condition: Column) -> DataFrame:
        return side(among.join(removed, "id", "left_anti"), "late").join(side(among, "early"), "t").where(condition).select("late", "early")

    return met(groups.where(F.col("lines") <= LARGE), near).union(met(large, near & least))


def removed_lines(own: DataFrame, bits: int, spread: int) -> DataFrame:
    """(id): the lines of `numbered` documents that an earlier line matches, removed itself or not."""
    marked = cut_table(marks(own, bits, spread))
    lines = marked.where("id is not null")
    repeated = cut(lines.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h", "g", "first"))
    copies = cut(lines.join(small_broadcast(repeated, PAIR_ROWS), ["h", "g"]).where("id != first").select("id"))
    firsts = entries(own, bits, *rarity(marked, spread)).join(small_broadcast(copies, PAIR_ROWS), "id", "left_anti")
    # One shuffle serves both sides: signatures are counted where they are, and most end here.
    dealt = firsts.select("id", "bits", "more", F.explode(F.arrays_zip("t", "at")).alias("x")).select("x.t", "id", "x.at", "bits", "more").repartition("t")
    heads = dealt.groupBy("t").agg(F.count("*").alias("lines"), F.min("id").alias("head"), F.min_by("at", "id").alias("head_at"), F.min_by("bits", "id").alias("head_bits"), F.min_by("more", "id").alias("head_more")).where("lines > 1")
    own_head = side(dealt, "late").join(heads.hint("shuffle_hash"), "t")
    near = (F.col("late") != F.col("head")) & may_reach("late", "head")
    met = cut_table(own_head.select("t", F.col("late").alias("id"), F.col("late_at").alias("at"), F.col("late_bits").alias("bits"), F.col("late_more").alias("more"), "lines", "head", near.alias("near")).where("near or lines > 2"))
    # First each line meets the head that it shares most signatures with, then those that this does not remove meet all that are earlier.
    heads_met = met.where("near").groupBy("id", "head").agg(F.count("*").alias("n"))
    tried = cut(heads_met.groupBy("id").agg(F.max_by("head", "n").alias("early")).select(F.col("id").alias("late"), "early"))
    by_first = cut(similar_pairs(tried, own, bits).select(F.col("late").alias("id")).distinct())
    left = small_broadcast(by_first, PAIR_ROWS)
    others = met.where("near").select(F.col("id").alias("late"), F.col("head").alias("early")).distinct().join(left, F.col("late") == F.col("id"), "left_anti")
    groups = met.where("lines > 2 and id != head")
    together = meeting_pairs(groups, left)
    second = cut(together.union(others).distinct())
    return copies.union(by_first).union(similar_pairs(second, own, bits).select(F.col("late").alias("id")).distinct())


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`numbered` documents, and (number, gone) with the line numbers to remove, sorted, for those that lose any."""
    own, bits, spread = numbered(docs)
    removed = removed_lines(own.select("number", "doc_id", "text"), bits, spread)
    gone = removed.groupBy(F.shiftright("id", bits).alias("number")).agg(F.sort_array(F.collect_set(F.col("id").bitwiseAND((1 << bits) - 1).cast("int"))).alias("gone"))
    return own, cut(gone)


def line_dedup(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined).

    A line goes if its set of words reaches a Jaccard similarity of 0.8 with any earlier line by (doc_id, line number), whether that one
    stays or not. Words are split at spaces and tabs and compared in lower case. Lines without words stay. A null text is one empty line.
    Repeated rows (same doc_id and text) are one document; a null doc_id comes first, different texts under one doc_id follow each other
    by a hash of the text. Of a very long text, whole lines of about `TOGETHER` characters are held at a time; an empty table gives no
    rows, and other columns, whatever their names, are not looked at.
    """
    own, gone = removals(docs.select("doc_id", "text"))
    sizes = own.select("number", "doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    out = sizes.join(small_broadcast(gone, LIST_ITEMS, "gone"), "number", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def with_deduped_text(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, with the text that `line_dedup` leaves. A document that loses every line has the empty text."""
    own, gone = removals(docs)
    joined = own.join(small_broadcast(gone, LIST_ITEMS, "gone"), "number", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("gone", k))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("doc_id", text.alias("text"), *[F.col("rest")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")])


def deduped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents without the lines that `line_dedup` removes."""
    return with_deduped_text(docs.select("doc_id", "text"))


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents
), line AS (
  SELECT doc_id, k, list_sort(list_distinct(list_filter(string_split(lower(trim(replace(raw, chr(9), ' '))), ' '), lambda w: w <> ''))) AS w FROM raw
), sets AS (
  SELECT w, len(w) AS n, min({'d': doc_id, 'k': k}) AS first FROM line WHERE len(w) >= 1 GROUP BY w
), ids AS (
  SELECT *, row_number() OVER (ORDER BY first) AS id FROM sets
), tok AS (
  SELECT id, n, unnest(w) AS t FROM ids
), freq AS (
  SELECT t, count(*) AS f FROM tok GROUP BY t
), pre AS (
  SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY f, t) AS p FROM tok JOIN freq USING (t)
), cand AS (
  SELECT DISTINCT a.id AS late, b.id AS early FROM pre a JOIN pre b ON a.t = b.t AND b.id < a.id
  WHERE a.p <= a.n - CAST(ceil(a.n * 0.8 - 1e-9) AS INTEGER) + 1 AND b.p <= b.n - CAST(ceil(b.n * 0.8 - 1e-9) AS INTEGER) + 1
    AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), good AS (
  SELECT DISTINCT late FROM cand JOIN ids x ON x.id = late JOIN ids y ON y.id = early
  WHERE 5 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n - len(list_intersect(x.w, y.w)))
), gone AS (
  SELECT line.doc_id, line.k FROM line JOIN ids USING (w) LEFT JOIN good ON late = id
  WHERE late IS NOT NULL OR (first.d, first.k) <> (line.doc_id, line.k)
), listed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS removed FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(coalesce(any_value(n_removed), 0) AS INTEGER) AS n_removed, coalesce(any_value(removed), '') AS removed
FROM raw LEFT JOIN listed USING (doc_id) GROUP BY doc_id
"""
