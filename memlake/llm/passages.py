"""Substring dedup: passages that several documents share, whatever stands around them and wherever their lines end.

The words of a document are cut into paragraphs at content-defined places: before a word whose hash is the least among its neighbours.
So a shared passage is cut alike in every document, but for its two ends. Equal paragraphs are one class from the start; the classes meet
on MinHash bands, are verified by exact Jaccard similarity of their shingles and clustered by connected components. The first paragraph of
a cluster stays; runs of removed paragraphs that are long enough are the passages to remove.

Numpy hashes and cuts inside tasks; the joins, counts and clusters are Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitTable, cut, cut_table, mixed
from .components import connected_components
from .linededup import TOGETHER, line_words, numbered, word_sets
from .minhash import THRESHOLD, WIDTH, bands_for, coefficients, verify_blocks

#: A word begins a paragraph if its hash is less than those of so many words on either side: paragraphs have 15 words on average, and a
#: passage of 50 words holds whole ones.
REACH = 7
#: Words of a passage at least; shorter repetitions (a stock phrase, a short line) stay.
LEAST_PASSAGE = 20
ROWS, TARGET = 2, 0.99
#: Buckets of so many sets at most are verified pair by pair in a join, larger ones in blocks of so many sets on average.
SMALL, BLOCK = 16, 256
SPACE = re.compile("[ \t\n]")
Batches = Iterator[pa.RecordBatch]


def parts_of(numbers: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about `TOGETHER` characters; a longer text comes in several parts, which end at a space."""
    own: list[int] = []
    parts: list[str] = []
    size = 0
    for number, text in zip(numbers, texts, strict=True):
        text, at = text.replace("\r", " "), 0
        while at >= 0:
            end = SPACE.search(text, at + TOGETHER) if len(text) - at > TOGETHER else None
            own.append(number)
            parts.append(text[at : end.start()] if end else text[at:])
            size += len(parts[-1])
            at = end.end() if end else -1
            if size > TOGETHER:
                yield own, parts
                own, parts, size = [], [], 0
    if parts:
        yield own, parts


class Paragraphs:
    """The paragraphs of groups of texts, in order: number, at (the place of the first word in its document), start (among the words of
    the group) and n words; and for each word its hash and its place in its paragraph."""

    def __init__(self) -> None:
        self.last, self.before = None, 0

    def __call__(self, own: list[int], parts: list[str]) -> None:
        place, self.hash, _ = line_words([0] * len(parts), parts)
        words = len(self.hash)
        part = np.repeat(np.arange(len(parts)), [p.count("\n") + 1 for p in parts])[place]
        order, begins = mixed(self.hash ^ np.uint64(0x5851F42D4C957F2D)), np.ones(words, bool)
        for k in range(1, REACH + 1):
            other = part[k:] != part[:-k]
            begins[k:] &= (order[k:] < order[:-k]) | other
            begins[:-k] &= (order[:-k] <= order[k:]) | other
        begins[:1] = True
        begins[1:] |= part[1:] != part[:-1]
        self.start = np.flatnonzero(begins)
        self.n = np.diff(self.start, append=words)
        self.inside = np.arange(words) - np.repeat(self.start, self.n)
        # A part may go on with the document of the part before it.
        sizes, bases = np.bincount(part, minlength=len(parts)), np.zeros(len(parts), np.int64)
        for k, number in enumerate(own):
            self.before = self.before if number == self.last else 0
            bases[k] = self.before
            self.last, self.before = number, self.before + int(sizes[k])
        first = np.cumsum(sizes) - sizes
        self.number = np.array(own, np.int64)[part[self.start]]
        self.at = self.start - first[part[self.start]] + bases[part[self.start]]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word, of the `width` words from it on, and whether these lie in its paragraph (fewer words: one shingle)."""
        length, total = np.repeat(self.n, self.n), np.zeros(len(self.hash), np.uint64)
        for k in range(width):
            fits = np.flatnonzero(self.inside + k < length)
            total[fits] = mixed(total[fits] + self.hash[fits + k] + np.uint64(k + 1))
        return total, (self.inside + width <= length) | (self.inside == 0)

    def bands(self, shingle: np.ndarray, real: np.ndarray, bands: int, rows: int, spare: int) -> np.ndarray:
        """MinHash bands of each paragraph, as hashes that lack the lowest `spare` bits."""
        a, b = coefficients(bands * rows)
        out = np.empty((len(self.start), bands), np.uint64)
        for band in range(bands):
            total = np.full(len(self.start), band + 1, np.uint64)
            for k in range(band * rows, band * rows + rows):
                value = np.where(real, mixed(shingle * a[k] + b[k]), np.iinfo(np.uint64).max)
                total = mixed(total + np.minimum.reduceat(value, self.start))
            out[:, band] = total >> np.uint64(spare)
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each paragraph's words in their order."""
        value = mixed(self.hash + self.inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.add.reduceat(value, self.start), np.add.reduceat(mixed(value ^ np.uint64(0xD1342543DE82EF95)), self.start)


def paragraphs(own: DataFrame, bits: int, bands: int, spare: int, width: int = WIDTH) -> DataFrame:
    """(id, n, h, g, bands): a row per paragraph; the id is the document's number and the place of its first word."""

    def look(batches: Batches) -> Batches:
        found = Paragraphs()
        for batch in batches:
            for numbers, parts in parts_of(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found(numbers, parts)
                if len(found.start):
                    h, g = found.keys()
                    band = found.bands(*found.shingles(width), bands, ROWS, spare)
                    columns = [pa.array(found.number << bits | found.at), pa.array(found.n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, band.size + 1, bands, dtype=np.int32), pa.array(band.ravel().view(np.int64)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "h", "g", "bands"])

    return own.mapInArrow(look, "id long, n int, h long, g long, bands array<long>")


def shingle_sets(own: DataFrame, ids: DataFrame, bits: int, width: int = WIDTH) -> DataFrame:
    """(id, shingles): the different shingles of the paragraphs `ids` (id) and of a few others, which a join by id leaves out. The documents
    are cut again where they are, so that their texts are not shuffled, however many paragraphs are asked for."""
    asked = BitTable(ids)

    def look(batches: Batches) -> Batches:
        found = Paragraphs()
        for batch in batches:
            for numbers, parts in parts_of(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found(numbers, parts)
                own_ids = found.number << bits | found.at
                keep = asked.has(own_ids)
                if keep.any():
                    shingle, real = found.shingles(width)
                    owner = np.repeat(np.arange(len(keep)), found.n)
                    real &= keep[owner]
                    key, start, _, unit = word_sets(owner[real], shingle[real])
                    yield pa.RecordBatch.from_arrays([pa.array(own_ids[unit]), pa.ListArray.from_arrays(np.append(start, len(key)).astype(np.int32), pa.array(key.view(np.int64)))], names=["id", "shingles"])

    return own.mapInArrow(look, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose shingle sets reach the threshold."""
    side = lambda name, words: sets.select(F.col("id").alias(name), F.col("shingles").alias(words))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.where(F.col("both") >= threshold * (F.col("n") - F.col("both")) - 1e-9).select("a", "b")


def links_of(classes: DataFrame, own: DataFrame, bits: int, threshold: float, width: int) -> DataFrame:
    """(a, b): links between `classes` (id, bands) that connect all classes that share a band and reach the threshold.

    In each bucket the classes first meet the least one. Those that do not resemble it meet the others of a small bucket; large buckets
    are verified in blocks of bounded size, where a task keeps its pairs to itself and returns the edges of a spanning forest.
    """
    dealt = classes.select("id", F.posexplode("bands").alias("k", "band")).repartition("k", "band")
    heads = dealt.groupBy("k", "band").agg(F.count("*").alias("members"), F.min("id").alias("head")).where("members > 1")
    met = cut_table(dealt.join(heads.hint("shuffle_hash"), ["k", "band"]))
    stars = cut(met.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
    sets = cut_table(shingle_sets(own, met.select("id"), bits, width))
    near = cut(verified(stars, sets, threshold))
    rest = met.where("members > 2 and id != head").join(near.select(F.col("a").alias("id"), F.col("b").alias("head"), F.lit(True).alias("linked")), ["id", "head"], "left").where("linked is null")
    rest = cut(rest.select("k", "band", "id", "members"))
    others = met.where(f"members between 3 and {SMALL} and id != head").select("k", "band", F.col("id").alias("b"))
    few = rest.where(f"members <= {SMALL}").join(others, ["k", "band"]).where("id != b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    mixed_buckets = rest.where(f"members > {SMALL}").select("k", "band").distinct()
    blocks = met.join(mixed_buckets, ["k", "band"], "left_semi").select("id", F.xxhash64("k", "band").alias("component"), F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"))
    placed = blocks.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = placed.join(sets, "id").select(F.col("id").alias("node"), "component", "blk", F.lit(1).cast("long").alias("copies"), "shingles", F.least("blk", "meets").alias("lo"), F.greatest("blk", "meets").alias("hi"))
    near = near.union(verified(few, sets, threshold))
    return cut(near.union(full.groupBy("component", "lo", "hi").applyInPandas(verify_blocks(threshold), "node long, links long, other long").select("node", "other")))


def clustered(own: DataFrame, bits: int, size: int, threshold: float, width: int, target: float) -> tuple[DataFrame, DataFrame]:
    """The paragraphs (id, n, h, g), and (h, g, kept) for the classes of which something is removed, kept being the first of the cluster."""
    bands = bands_for(target, threshold, ROWS)
    spare = max(1, 64 - size.bit_length() - 4)  # as many bits as tell so many paragraphs' bands apart
    units = cut_table(paragraphs(own, bits, bands, spare, width))
    first_bands = [F.first(F.col("bands")[k]).alias(f"b{k}") for k in range(bands)]
    classes = cut_table(units.groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *first_bands).select("h", "g", "id", "copies", F.array(*[f"b{k}" for k in range(bands)]).alias("bands")))
    clusters = connected_components(links_of(classes.select("id", "bands"), own, bits, threshold, width).select("a", "b"))
    named = classes.select("h", "g", "id", "copies").join(clusters.withColumnRenamed("node", "id"), "id", "left")
    return units.select("id", "n", "h", "g"), named.where("copies > 1 or component is not null").select("h", "g", F.coalesce("component", "id").alias("kept"))


def long_enough(removed: DataFrame, bits: int, least: int) -> DataFrame:
    """Those of the `removed` paragraphs (id, n) that follow each other in a document and have `least` words together."""
    from pyspark.sql import Window

    by_document = Window.partitionBy("number").orderBy("at")
    placed = removed.withColumns({"number": F.shiftright("id", bits), "at": F.col("id").bitwiseAND((1 << bits) - 1)})
    new = placed.withColumn("new", F.when(F.lag(F.col("at") + F.col("n")).over(by_document) == F.col("at"), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(by_document))
    return runs.withColumn("together", F.sum("n").over(Window.partitionBy("number", "run"))).where(F.col("together") >= least).drop("new", "together")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_PASSAGE, target_recall: float = TARGET, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """A row for each paragraph to remove: doc_id, passage (number of the passage in its document, from 1), start_word (from 0), n_words,
    and the paragraph that is kept of its cluster: kept_doc_id, kept_start_word.

    Words are split at spaces, tabs and line ends and compared in lower case. Paragraphs whose sets of `width`-word shingles reach
    `threshold` are linked (exactly that similarity is missed with a chance of 1 - `target_recall` at most; equal ones never); of each
    connected component the first by (doc_id, place) stays. Removed paragraphs that follow each other are a passage; passages of fewer
    than `least_words` words stay. Null, empty and blank texts have no rows; repeated rows (same doc_id and text) count once; rows
    without a doc_id come first, different texts under one doc_id follow each other by a hash of the text. A text of more than `TOGETHER`
    characters is taken in parts, at whose ends paragraphs end. Other columns, whatever their names, are not looked at.
    """
    own, bits, _ = numbered(docs.select("doc_id", "text"))
    size = int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    names = own.select("number", "doc_id")
    units, kept = clustered(own.select("number", "text"), bits, size // 64, threshold, width, target_recall)
    removed = cut_table(units.join(kept, ["h", "g"]).where("id != kept").select("id", "n", "kept"))
    found = long_enough(removed, bits, least_words).withColumn("kept_number", F.shiftright("kept", bits))
    place: Column = F.col("kept").bitwiseAND((1 << bits) - 1)
    out = found.join(names, "number").select("doc_id", F.col("run").alias("passage"), F.col("at").alias("start_word"), F.col("n").cast("long").alias("n_words"), "kept_number", place.alias("kept_start_word"))
    return out.join(names.select(F.col("number").alias("kept_number"), F.col("doc_id").alias("kept_doc_id")), "kept_number").select("doc_id", "passage", "start_word", "n_words", "kept_doc_id", "kept_start_word")
