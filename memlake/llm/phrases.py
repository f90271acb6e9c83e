"""Phrase collocations: a generalised suffix automaton of each shard counts its phrases, counts are reduced globally, scores are exact.

A shard is some megabytes of text. Its automaton is cut at three words: a node is a phrase, its suffix link drops the phrase's first word,
and the ends of a phrase (its endpos) are those of all phrases that link to it, and its own where a piece begins with it. The nodes are
kept sorted by their words from the last to the first, so that what links to a node stands beside it. One sort of all positions therefore
gives the deepest nodes with their counts, and sums over runs pass the counts up the links: no transition is walked per word in Python.

Every phrase a shard holds goes, with its count, to a bucket by the hash of its words, in compressed Arrow batches. A phrase comes once per
shard however often it occurs, so a hot phrase is one row a shard. Buckets are as many as the corpus has bytes for, so a bucket fits a task
at any size. What follows (parts, exact scores, links to longer phrases, ranks) is DataFrame work on the frequent phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_table, mixed

DEPTH = 3
#: UTF-8 bytes of a shard. Its words stay under 2^21, so that three of them fit a 63-bit key; see `suffix_nodes` for when they do not.
SHARD_BYTES = 12_000_000
#: UTF-8 bytes of the corpus for each bucket of the reduction.
BUCKET_BYTES = 6_000_000
UNKNOWN = "und"
#: Groups that rank alone before a language's best meet, so that the last ranking takes at most so many times `best` rows.
RANKED_APART = 64

BREAK = 0xFF  # no byte of UTF-8
TABLE = bytes(BREAK if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
IPC = pa.ipc.IpcWriteOptions(compression="zstd")


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words, pieces): all words of the texts in order, and the number of the piece that each stands in. No piece spans two texts."""
    data = bytes([BREAK]).join(texts).translate(TABLE)
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (codes != 0x20) & (codes != BREAK), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    pieces = np.searchsorted(np.flatnonzero(codes == BREAK), starts)
    lengths = ends - starts
    keep = np.flatnonzero((codes != 0x20) & (codes != BREAK))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes[keep].tobytes())])
    return words, pieces


class Nodes:
    """The nodes of one length: their words from the first to the last (ids), and their counts."""

    def __init__(self, ids: list[np.ndarray], counts: np.ndarray):
        self.ids, self.counts = ids, counts


def suffix_nodes(ids: np.ndarray, pieces: np.ndarray) -> list[Nodes]:
    """The automaton's nodes of one, two and three words. `ids` are from 1 on; 0 stands before a piece.

    The key of a position is (word, word before, word before that). Sorted, the nodes that link to one node are a run, whose counts add
    up to its own. Ids too large for one key are first numbered by their pairs."""
    base = int(ids.max(initial=0)) + 1
    before, far = np.zeros_like(ids), np.zeros_like(ids)
    before[1:] = np.where(pieces[1:] == pieces[:-1], ids[:-1], 0)
    far[2:] = np.where(pieces[2:] == pieces[:-2], ids[:-2], 0)
    pairs = ids * base + before
    if base < 1 << 21:
        deepest, counts = np.unique(pairs * base + far, return_counts=True)
        pair, first = np.divmod(deepest, base)
    else:
        names, rank = np.unique(pairs, return_inverse=True)
        deepest, counts = np.unique(rank * base + far, return_counts=True)
        rank, first = np.divmod(deepest, base)
        pair = names[rank]
    last, middle = np.divmod(pair, base)
    found = [Nodes([first[first > 0], middle[first > 0], last[first > 0]], counts[first > 0])]
    runs = np.flatnonzero(np.diff(pair, prepend=-1))
    last, middle, counts = last[runs], middle[runs], np.add.reduceat(counts, runs)
    found.append(Nodes([middle[middle > 0], last[middle > 0]], counts[middle > 0]))
    runs = np.flatnonzero(np.diff(last, prepend=-1))
    found.append(Nodes([last[runs]], np.add.reduceat(counts, runs)))
    return found[::-1]


def _packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([phrases, pa.array(counts.astype(np.int64))], names=["phrase", "f"])
    with pa.ipc.new_stream(sink, batch.schema, options=IPC) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def shard_counts(texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed phrases with counts) of one shard. The empty phrase of bucket 0 counts the shard's words."""
    words, pieces = words_of(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    names = coded.dictionary
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))
    del words, coded
    for nodes in suffix_nodes(ids, pieces):
        if not len(nodes.counts):
            continue
        h = np.zeros(len(nodes.counts), np.uint64)
        for k, part in enumerate(nodes.ids):
            h = mixed(h + hashes[part - 1] + np.uint64(k + 1))
        at = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[b] : bounds[b + 1]]
            parts = [names.take(pa.array(part[own] - 1)) for part in nodes.ids]
            yield int(b), _packed(parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())), nodes.counts[own])
    yield 0, _packed(pa.array([b""], pa.large_binary()), np.array([len(ids)]))


def _shards(buckets: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flushed(lang: str) -> Iterator[pa.RecordBatch]:
            for b, payload in shard_counts(held.pop(lang), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b], pa.int32()), pa.array([payload], pa.binary())], names=["lang", "bucket", "payload"])
            size.pop(lang)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= SHARD_BYTES:
                    yield from flushed(lang)
                elif sum(size.values()) >= 4 * SHARD_BYTES:
                    yield from flushed(max(size, key=size.get))
        for lang in list(held):
            yield from flushed(lang)

    return counted


def _reduced(least: int):
    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [p for batch in batches for p in batch.column("payload").to_pylist()]
        tables = [pa.ipc.open_stream(p).read_all() for p in payloads]
        total = pa.concat_tables(tables).combine_chunks().group_by("phrase", use_threads=False).aggregate([("f", "sum")])
        total = total.filter(pc.or_(pc.greater_equal(total["f_sum"], least), pc.equal(total["phrase"], pa.scalar(b"", pa.large_binary()))))
        for batch in total.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * batch.num_rows, pa.string()), batch["phrase"].cast(pa.binary()), batch["f_sum"]], names=["lang", "phrase", "f"])

    return summed


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> DataFrame:
    """(lang, phrase, f): every phrase of one to three words that occurs `least` times or more in a language, and the empty phrase with
    the number of all its words. Exact over whole texts; occurrences may overlap, and none spans two pieces."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    shards = rows.mapInArrow(_shards(buckets), "lang string, bucket int, payload binary")
    found = shards.groupBy("lang", "bucket").applyInArrow(_reduced(least), "lang string, phrase binary, f long")
    return cut_table(found.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"))


def _words(phrase: str, n: Column) -> Column:
    """The first n words of a phrase, or the last -n."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, covered_percent: int = 50, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `best` phrases of two or three words of each language.

    Texts are cut at `. , ; : ! ?` and line ends into pieces, and those at blanks and tabs into words; A-Z count as lower case. A phrase
    occurs a >= `least` times within pieces. Cut after k words, its parts occur l and r times and score floor(1000000 a a / (l r)); the
    least score counts, the least k on a tie. A phrase inside a longer candidate that occurs in `covered_percent` of its places or more is
    dropped. Ranks go by score and a, falling, then by the phrase's bytes. Decimals of 38 digits keep the products exact.

    A null text is empty, a null language is `und`; rows are never told apart by ids, so repeated rows count again. Texts of any length
    are read whole. Other columns are left behind. An empty table, or one without frequent phrases, gives no rows.
    """
    counts = phrase_counts(docs, text_col, lang_col, least)
    words = F.size(F.split("phrase", " "))
    known = counts.where("phrase != ''").select("lang", "phrase", "f", words.alias("words"))
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    candidates = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words")

    # the parts at each cut
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("phrase", F.col("k")).alias("left"), _words("phrase", F.col("k") - F.col("words")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = F.expr("(1000000BD * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))

    # suffix links, and the same from the other end: the phrases one word shorter that a candidate holds
    longer = candidates.where("words > 2")
    inner = F.array(_words("phrase", 1 - F.col("words")), _words("phrase", F.col("words") - 1))
    covers = longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    open_ = scored.join(covers, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered_percent))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = open_.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)).alias("apart"))
    near = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "apart").orderBy(*order))).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by plain grouping of every phrase.
ORACLE = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS nr, regexp_extract_all(piece, '[^ \t]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents)),
words AS (SELECT lang, nr, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM pieces),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY nr ORDER BY p)),
counts AS (
    SELECT lang, w1 AS phrase, 1 AS words, count(*) AS f FROM runs GROUP BY lang, w1
    UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
cuts AS (
    SELECT lang, phrase, words, f AS a, k, array_to_string(s[:k], ' ') AS p1, array_to_string(s[k + 1:], ' ') AS p2
    FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, words)) AS k FROM counts WHERE words > 1)),
scored AS (
    SELECT c.lang, c.phrase, c.words, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p1 JOIN counts y ON y.lang = c.lang AND y.phrase = c.p2
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, f, string_split(phrase, ' ') AS s FROM counts WHERE words = 3),
covers AS (SELECT lang, phrase, max(f) AS longest FROM (SELECT lang, f, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM longer) GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, n.n, s.score::BIGINT AS score
FROM scored s JOIN n ON n.lang = s.lang LEFT JOIN covers v ON v.lang = s.lang AND v.phrase = s.phrase
WHERE v.longest IS NULL OR 100 * v.longest < 50 * s.a
QUALIFY rank <= 2000
"""
