"""Near-duplicate classes by MinHash banding, with every candidate pair verified on full shingle sets.

Equal sets are one class from the start, so copies never meet in pairs. Classes that share a band hash are candidates; candidates are
gathered into candidate components by star edges (one per class and band, never the pairs of a bucket), and a component is verified in
blocks of bounded size. A block task keeps its pairs to itself: it returns a row per class, with its links and one edge of a spanning
forest. So rows stay in proportion to classes and blocks, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, intake, mixed, shingles, small_broadcast
from .components import connected_components

WIDTH, THRESHOLD = 5, 0.8
#: Classes of a block on average; a task verifies two blocks.
BLOCK = 256
#: Sets whose places may be broadcast, of some hundred bytes each; more are joined by a shuffle.
BROADCAST_ITEMS = 500_000

Units = Callable[[str], list[tuple[int, list[str]]]]


@cache
def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and summands, one pair per hash function."""
    drawn = np.random.default_rng(20240229).integers(1, 1 << 63, (2, n), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def band_hashes(shingle: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of the MinHash signature; the band's number is part of it."""
    a, b = coefficients(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingle), 4096):  # long texts by slices, for memory
        part = shingle[k : k + 4096, None] * a
        part += b
        np.minimum(least, (part >> np.uint64(16)).min(axis=0), out=least)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = mixed(total + least[k::rows])
    return total


def recall(similarity: float, bands: int, rows: int) -> float:
    """The chance that two sets of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(target: float, similarity: float = THRESHOLD, rows: int = 5) -> int:
    """The least number of bands with which `similarity` is found with a chance of `target` at least."""
    return int(np.ceil(np.log(1 - target) / np.log(1 - similarity**rows)))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): texts with a hash, which tells rows without a doc_id apart."""
    return intake(docs).withColumn("mark", F.xxhash64("text"))


def place() -> Column:
    """What units are ordered and told apart by: doc_id, then unit. Texts without a doc_id come last, by their marks."""
    nameless = F.col("doc_id").isNull()
    return F.struct(nameless.alias("nameless"), "doc_id", F.when(nameless, F.col("mark")).alias("own_mark"), "unit")


def signatures(docs: DataFrame, units: Units, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, unit, words, key, bands) for each unit that `units` finds in a text, mark being the text's hash; units without words
    have neither key nor bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for unit, words in units(text.as_py()):
                    s = shingles(words, hashes, width)
                    if len(s):
                        out.append((doc_id, mark, unit, len(words), xxhash.xxh3_128_digest(s.tobytes()), band_hashes(s, bands, rows).view(np.int64)))
                    else:
                        out.append((doc_id, mark, unit, 0, None, None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "mark", "unit", "words", "key", "bands"])

    return marked(docs).mapInArrow(sign, "doc_id long, mark long, unit int, words long, key binary, bands array<long>")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|a & b| for each a of `left` and b of `right` (sorted distinct hashes), by slices of the values that two sets share."""
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64)
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    often = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    width, sizes = int(often.sum()), [len(x) for x in left + right]
    own = np.repeat(np.arange(len(sizes)), sizes)[keep := often[at]]
    column = place[at[keep]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, width, 2048):
        i, j = np.searchsorted(column, [lo, lo + 2048])
        has = np.zeros((len(sizes), 2048), np.float32)
        has[own[i:j], column[i:j] - lo] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return np.rint(out).astype(np.int64)


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each a and b reaches `threshold`."""
    both = intersections(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - both
    return both >= threshold * union - 1e-9


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least vertex that it reaches over `pairs`."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        root = root[root]
        if (root == before).all():
            break
    return root


LINKS = "node long, links long, other long"


def verify_blocks(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one task's rows (node, component, blk, lo, hi, copies, shingles): a row per class with the documents it links to and an edge
    of the spanning forest."""

    def one(frame: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        weight = frame["copies"].to_numpy()
        block = frame["blk"].to_numpy()
        left = np.flatnonzero(block == lo)
        right = np.flatnonzero(block == hi) if hi != lo else left
        links, pairs = np.zeros(len(frame), np.int64), np.empty((0, 2), np.int64)
        if len(left) and len(right):
            near = similar([sets[i] for i in left], [sets[i] for i in right], threshold)
            if hi == lo:
                np.fill_diagonal(near, False)
            links[left] += near @ weight[right]
            if hi != lo:
                links[right] += near.T @ weight[left]
            i, j = np.nonzero(near)
            pairs = np.stack([left[i], right[j]], axis=1)
        node = frame["node"].to_numpy()
        out = pd.DataFrame({"node": node, "links": links, "other": node[forest(pairs, len(frame))]})
        return out[links > 0]

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [one(x, lo, hi) for (_, lo, hi), x in frame.groupby(["component", "lo", "hi"])]
        return pd.concat(parts) if parts else pd.DataFrame({"node": [], "links": [], "other": []}, dtype="int64")

    return task


def shingle_sets(docs: DataFrame, wanted: DataFrame, units: Units, width: int = WIDTH) -> DataFrame:
    """`wanted` (node, component, blk, blocks, copies, key and the doc_id, mark and unit that carry it) with the full shingle sets."""
    carriers = cut(wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("unit", "key", "node", "component", "blk", "blocks", "copies")).alias("own")))
    texts, carriers = marked(docs), small_broadcast(carriers, BROADCAST_ITEMS, "own")
    joined = texts.join(carriers, texts.doc_id.eqNullSafe(carriers.doc_id) & (texts.mark == carriers.mark)).select("own", "text")
    own = pa.schema([(x, pa.int64()) for x in ("node", "component", "blk", "blocks", "copies")] + [("shingles", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: dict[str, list] = {x: [] for x in own.names}
            for carried, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = dict(units(text.as_py()))
                for x in carried:
                    s = shingles(words.get(x["unit"], []), hashes, width)
                    if xxhash.xxh3_128_digest(s.tobytes()) == x["key"]:
                        for name in own.names[:-1]:
                            out[name].append(x[name])
                        out["shingles"].append(s.tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=own)

    return joined.mapInArrow(read, "node long, component long, blk long, blocks long, copies long, shingles binary")


def near_classes(docs: DataFrame, signed: DataFrame, units: Units, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """A row per distinct shingle set of `signed` (`signatures`, cut): key, first (its `place`), copies, class_first (the first of the
    near-duplicate class) and links (documents or units in other sets that reach the threshold)."""
    sets = signed.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct(place().alias("first"), "mark", "bands")).alias("x"))
    sets = cut(sets.select("key", "copies", "x.first", "x.mark", F.col("x.bands").alias("bands"), F.monotonically_increasing_id().alias("node")))
    hashed = sets.select("node", F.explode("bands").alias("band"))
    met = hashed.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    stars = hashed.join(met, "band").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    candidates = connected_components(stars)
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    placed = candidates.join(sizes, "component").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    carriers = sets.select("node", "key", "copies", "first.doc_id", "mark", "first.unit")
    wanted = cut(placed.join(carriers, "node"))
    full = shingle_sets(docs, wanted, units, width)
    # A set meets each block of its component once; small components share tasks.
    dealt = full.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "component", "blk", "copies", "shingles", F.least("blk", "meets").alias("lo"), F.greatest("blk", "meets").alias("hi"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, wanted.count() // BLOCK)))).otherwise(-F.col("component") - 1).alias("share"))
    verified = cut(dealt.groupBy("share", "lo", "hi").applyInPandas(verify_blocks(threshold), LINKS))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))
    firsts = sets.select("node", "first")
    named = classes.join(firsts, "node")
    class_first = named.groupBy("component").agg(F.min("first").alias("class_first"))
    of_node = classes.join(class_first, "component").join(links, "node").select("node", "class_first", "links")
    return sets.select("node", "key", "first", "copies").join(of_node, "node", "left").select("key", "first", "copies", F.coalesce("class_first", "first").alias("class_first"), F.coalesce("links", F.lit(0)).alias("links"))


def whole_text(text: str) -> list[tuple[int, list[str]]]:
    """The whole text as one unit: its words in lower case."""
    return [(0, text.lower().split())]


def jaccard_join(docs: DataFrame, target_recall: float = 0.9995, rows: int = 5, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Documents as near-duplicate classes: doc_id, class_id (the least doc_id of the class, null if none has any), n_copies (documents with equal shingle
    sets, itself included) and n_links (other documents whose shingle sets reach `threshold`, copies included).

    Words are split at white space and compared in lower case; a text of one to four words is a single shingle. A text without words
    (null, empty, blank) links to nothing and is its own class. A row that is repeated (same doc_id, same set) counts once; a doc_id
    with different texts has a row for each. A pair of exactly the threshold is missed with a chance of 1 - `target_recall` at most.
    """
    signed, classes = _signed_classes(docs, target_recall, rows, threshold, width)
    found = signed.where("key is not null").select("doc_id", "key").distinct().join(classes, "key").select("doc_id", F.col("class_first.doc_id").alias("class_id"), F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = signed.where("key is null").select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def later_copies(docs: DataFrame, target_recall: float = 0.9995, rows: int = 5, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark) of the texts that are not the first of their near-duplicate class. Texts under the first's own doc_id stay with it."""
    signed, classes = _signed_classes(docs, target_recall, rows, threshold, width)
    found = signed.select("doc_id", "mark", "key", place().alias("own")).join(classes.where("copies > 1 or links > 0").select("key", "class_first"), "key")
    return found.where(F.struct("own.nameless", "own.doc_id", "own.own_mark") != F.struct("class_first.nameless", "class_first.doc_id", "class_first.own_mark")).select("doc_id", "mark").distinct()


def _signed_classes(docs: DataFrame, target_recall: float, rows: int, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of the whole texts, a row for each, and the classes of their sets. Texts of a doc_id with equal sets count once;
    without a doc_id they count by their marks only where the classes are named."""
    signed = cut(signatures(docs, whole_text, bands_for(target_recall, threshold, rows), rows, width))
    return signed, near_classes(docs, signed.dropDuplicates(["doc_id", "key"]), whole_text, threshold, width)
