"""LM scoring: the marginal probability of a text over all ways to spell its words with an existing piece vocabulary.

The vocabulary's own scores give each piece a prior weight; the training documents' counts of pieces sharpen it. A word's probability
sums over every segmentation (forward recursion in log space), and depends on the word alone, so it is computed once per distinct word
of the corpus. The frequent words travel to the documents, the rest of the documents' words travel to their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_remainder, intake

#: Words whose figures every task holds: the most frequent ones, at most so many whatever the corpus.
FREQUENT_WORDS = 1 << 17
#: Pseudo-counts that the vocabulary's own scores are worth, in all.
PRIOR_WEIGHT = 1000.0
END = b"\n"  # no word holds white space, so this names the end of a text


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, with A-Z in lower case; bytes methods touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, bound: int = 400_000) -> DataFrame:
    """(word binary, n long: in training documents, n_all long). `docs` has doc_id, text and held_out. The end of a text is a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            every = known.keys() | other.keys()
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([known[w] for w in every], pa.int64()), pa.array([known[w] + other[w] for w in every], pa.int64())], names=["word", "n", "n_all"])
            known.clear()
            other.clear()
            return out

        known: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()
        for batch in batches:
            for held_out, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (other if held_out else known).update([*words_of(text.as_py()), END])
                if len(known) + len(other) > bound:
                    yield flushed()
        yield flushed()

    parts = docs.select("held_out", "text").mapInArrow(count, "word binary, n long, n_all long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


class Pieces:
    """A piece vocabulary with log10 weights, and the marginal probability of words under it."""

    def __init__(self, weights: dict[str, float], end: float):
        self.weights, self.end = weights, end
        self.longest = max(map(len, weights))
        self.bytes = [weights[f"<0x{b:02X}>"] for b in range(256)]

    def word(self, word: str) -> float:
        """log10 of the summed probability of all segmentations of a word, its begin mark included."""
        s = "▁" + word
        get, longest, ln10 = self.weights.get, self.longest, math.log(10)
        alpha = [0.0]
        for i in range(1, len(s) + 1):
            c = s[i - 1]
            terms = [alpha[i - 1] + sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))]
            for j in range(max(0, i - longest), i):
                if (w := get(s[j:i])) is not None:
                    terms.append(alpha[j] + w)
            top = max(terms)
            alpha.append(top if len(terms) == 1 else top + math.log10(sum(math.exp((t - top) * ln10) for t in terms)))
        return alpha[-1]


def piece_counts(words: DataFrame, model_path: str) -> DataFrame:
    """(piece int, n long): how often the vocabulary's own segmentation of the training words uses each piece; at most one row a piece."""

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        total = np.zeros(sp.vocab_size(), np.int64)
        for x in frames:
            ids = sp.encode([w.decode("utf-8", "replace") for w in x["word"]], num_threads=1)
            n = np.repeat(x["n"].to_numpy(), [len(i) for i in ids])
            flat = np.fromiter((i for own in ids for i in own), np.int64, len(n))
            np.add.at(total, flat, n)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"piece": used.astype(np.int32), "n": total[used]})

    return words.where((F.col("n") > 0) & (F.col("word") != F.lit(END))).select("word", "n").mapInPandas(spell, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def trained_pieces(words: DataFrame, model_path: str) -> Pieces:
    """Weights from the vocabulary's scores (as a Zipf law of their rank) and the corpus counts. The counts are one row a piece."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    n = sp.vocab_size()
    scores = np.array([sp.get_score(i) for i in range(n)])
    usable = np.array([not sp.is_control(i) and not sp.is_unknown(i) for i in range(n)])
    rank = np.empty(n)
    rank[np.argsort(-scores, kind="stable")] = np.arange(n)
    prior = usable / (rank + 2.7)
    weight = PRIOR_WEIGHT * prior / prior.sum()
    for r in piece_counts(words, model_path).collect():
        weight[r["piece"]] += r["n"] * usable[r["piece"]]
    ends = words.where(F.col("word") == F.lit(END)).select("n").first()
    end = 1.0 + (ends["n"] if ends else 0)
    total = weight.sum() + end
    return Pieces({sp.id_to_piece(i): math.log10(weight[i] / total) for i in range(n) if usable[i]}, math.log10(end / total))


def frequent_from(words: DataFrame, most: int) -> int | None:
    """The count from which words are frequent, so that `most` of them are at most; None if even the most frequent are too many. It is read
    off the numbers of words per eighth of an octave of the count: a few hundred rows, whatever the corpus."""
    sizes = words.groupBy(F.floor(F.log2(F.col("n_all").cast("double")) * 8).alias("step")).agg(F.count("*").alias("n"), F.min("n_all").alias("least"))
    taken, least = 0, None
    for r in sorted(sizes.collect(), key=lambda r: -r["step"]):
        taken += r["n"]
        if taken > most:
            break
        least = r["least"]
    return least


def key64(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(word), "little", signed=True)


def key32(word: bytes) -> int:
    """Another hash, by another function: words are told apart by 96 bits."""
    return int.from_bytes(xxhash.xxh32_digest(word), "little", signed=True)


ROW = "doc_id long, h long, g int, tokens long, known long, base double, lattice double, copies int, mark long"


def score_texts(docs: DataFrame, model_path: str, modulus: int, remainder: int, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text).

    Rows whose crc32(doc_id as text) mod `modulus` is `remainder` are held out: nothing is learnt from them. Tokens are words and one end
    per text; a null or empty text is the end alone. base_score is the add-one word score, score the log10 marginal probability under the
    piece lattice. Repeated rows (same doc_id and text) come out as often as they came in; an empty table gives no rows.
    """
    held_out = (id_remainder("doc_id", modulus) == remainder).alias("held_out")
    own = intake(docs)
    words = cut(word_counts(own.select("doc_id", "text", held_out)))
    known = words.where("n > 0").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    n_train = int(known["tokens"] or 0)
    floor = math.log10(n_train + known["distinct"] + 1)
    pieces = trained_pieces(words, model_path)

    def lattice(word: bytes) -> float:
        return pieces.end if word == END else pieces.word(word.decode("utf-8", "surrogatepass"))

    def figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"h": [key64(w) for w in x["word"]], "g": [key32(w) for w in x["word"]], "n": x["n"], "word_lattice": [lattice(w) for w in x["word"]]})

    def spelt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.assign(word_lattice=[lattice(w) for w in x["word"]])

    lexicon = words.mapInPandas(figures, "h long, g int, n long, word_lattice double")
    least = frequent_from(words, frequent_words)
    top = words.where(F.lit(least is not None) & (F.col("n_all") >= F.lit(least or 0))).select("word", "n").mapInPandas(spelt, "word binary, n long, word_lattice double").toPandas()  # frequent_words rows at most
    at = {bytes(w): k for k, w in enumerate(top["word"])}
    n = top["n"].to_numpy(np.int64)
    # The last row stands for the words that are not here.
    held = np.vstack([np.stack([n > 0, np.log10(n + 1.0) - floor, top["word_lattice"].to_numpy(np.float64)], axis=1).reshape(-1, 3), np.zeros(3)])
    frequent = docs.sparkSession.sparkContext.broadcast((at, held))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = frequent.value
        kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int32(), pa.int64()]
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                found = words_of(raw)
                found.append(END)
                ids = np.fromiter((at.get(w, -1) for w in found), np.int64, len(found))
                sums = table[ids].sum(axis=0)
                mark = key64(raw.encode("utf-8", "surrogatepass"))
                rare = Counter([found[k] for k in np.flatnonzero(ids < 0)])
                more = len(rare)
                for col, value, rest in zip(cols, (doc_id, mark, 0, len(found), int(sums[0]), sums[1], sums[2], 1, mark), ([doc_id] * more, map(key64, rare), map(key32, rare), rare.values(), [0] * more, [0.0] * more, [0.0] * more, [0] * more, [mark] * more), strict=True):
                    col.append(value)
                    col.extend(rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    # A row for each text with the sums over its frequent words (copies = 1), and one for each of its other words (copies = 0), which
    # meets the word's figures. The former are dealt out by a hash of the text and match nothing.
    rows = own.mapInArrow(look_up, ROW)
    met = rows.join(lexicon, (rows.h == lexicon.h) & (rows.g == lexicon.g) & (rows.copies == 0), "left")
    base = F.log10(F.col("n") + 1) - F.lit(floor)
    own_or = lambda c, other: F.when(F.col("copies") == 1, F.col(c)).otherwise(F.col("tokens") * other).alias(c)
    each = met.select("doc_id", "mark", "copies", F.when(F.col("copies") == 1, F.col("tokens")).otherwise(0).alias("tokens"), own_or("known", (F.col("n") > 0).cast("long")), own_or("base", base), own_or("lattice", F.col("word_lattice")))
    summed = each.groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "lattice", "copies")])
    share = lambda c: F.col(c) / F.col("copies")
    out = summed.select("doc_id", held_out, share("tokens").cast("long").alias("n_tokens"), share("known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("lattice").alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def lattice_scores(docs: DataFrame, model_path: str) -> DataFrame:
    """`score_texts` with the documents of crc32(doc_id) mod 7 = 2 held out."""
    return score_texts(docs, model_path, 7, 2)
