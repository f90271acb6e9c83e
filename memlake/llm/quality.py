"""Quality classifier: random-indexing vectors pooled per document, a two-layer network on top, temperature-calibrated.

Every word and every word shape (the pattern of its letters and marks) has a sparse random index vector. A word's vector is the sum of
its neighbours' index vectors over the training sample; shapes keep their index vectors. A document is the mean of both over its whole
text, with a few length figures. Nothing but the text enters a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_sample, id_remainder, intake

WORDS, SHAPES, DIM = 8192, 512, 48
#: The labelled documents that are learnt from, about: those with the least hashes of their ids.
SAMPLE = 6000
FEATURES = 2 * DIM + 4
HIDDEN, EPOCHS, BATCH = 32, 60, 256
PREDICTED_FROM = 0.3
LETTERS = re.compile(r"[^\W\d_]+")


def shape_of(token: str) -> str:
    """Runs of capitals, small letters and digits as X, x and 9; marks as they are, repeats once."""
    out = []
    for c in token:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class TokenCodes(dict):
    """token -> word bucket * SHAPES + shape bucket, with bounded memory."""

    def __missing__(self, token: str) -> int:
        word = "".join(LETTERS.findall(token.lower()))
        code = xxhash.xxh32_intdigest(word) % WORDS * SHAPES + xxhash.xxh32_intdigest(shape_of(token)) % SHAPES
        if len(token) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[token] = code
        return code

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors: six entries of 1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, 6, replace=False)] = rng.choice([-1, 1], 6)
    return out


def neighbours(codes: np.ndarray, words: np.ndarray, shapes: np.ndarray, total: np.ndarray) -> None:
    """Adds to each word's row of `total` the index vectors of the two tokens on either side."""
    own = words[codes // SHAPES] + shapes[codes % SHAPES]
    around = np.zeros_like(own)
    for k in (1, 2):
        if len(own) > k:
            around[k:] += own[:-k]
            around[:-k] += own[k:]
    np.add.at(total, codes // SHAPES, around)


def features(codes: np.ndarray, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The pooled vectors and the figures of a text, as one row."""
    n = len(codes)
    if not n:
        return np.zeros(FEATURES, np.float32)
    figures = [np.log1p(n), len(np.unique(codes)) / n, len(np.unique(codes % SHAPES)) / n, np.count_nonzero(codes[1:] == codes[:-1]) / n]
    return np.concatenate([vectors[codes // SHAPES].mean(axis=0), shapes[codes % SHAPES].mean(axis=0), figures]).astype(np.float32)


@dataclass
class Network:
    """tanh hidden layer, logistic output divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fitted(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the temperature that makes the others likeliest. Without rows of both labels, the labels' mean."""
    rng = np.random.default_rng(seed)
    net = Network(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), x.std(axis=0) + 1e-3 if len(x) else np.ones(x.shape[1]), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if len(np.unique(y)) < 2:
        net.w2, net.b2 = np.zeros(HIDDEN), 0.0 if not len(y) else 3.0 if y[0] else -3.0
        return net
    order = rng.permutation(len(x))
    keep, train = order[: len(x) // 5], order[len(x) // 5 :]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for k in range(0, len(train), BATCH):
            rows = train[k : k + BATCH]
            z = (x[rows] - net.mean) / net.scale
            hidden = np.tanh(z @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-(hidden @ net.w2 + net.b2))) - y[rows]) / len(rows)
            back = error[:, None] * net.w2 * (1 - hidden**2)
            grads = [z.T @ back + 1e-4 * net.w1, back.sum(axis=0), hidden.T @ error + 1e-4 * net.w2, np.array([error.sum()])]
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            moves = []
            for g, s in zip(grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                moves.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    if len(keep):
        logits, own = net.logits(x[keep]), y[keep]
        loss = lambda t: float(np.mean(np.logaddexp(0, -logits / t) * own + np.logaddexp(0, logits / t) * (1 - own)))
        net.temperature = min(np.geomspace(0.25, 8, 60), key=loss)
    return net


@dataclass
class Model:
    vectors: np.ndarray
    shapes: np.ndarray
    network: Network


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(text, y) of about `sample` labelled documents, without those of crc32(doc_id) mod 5 = 0. Of several labels of a doc_id the least
    counts, of several texts the one with the least hash. The labels' size is so bounded by `sample`, and they alone are broadcast."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(id_remainder("doc_id", 5) != 0)
    chosen = hash_sample(usable.groupBy("doc_id").agg(F.min("y").alias("y")), sample, "doc_id")
    own = intake(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return own.select("text", "y").repartition(8)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors and network from a bounded sample: the texts stay on the executors, a vector per text reaches the driver."""
    rows = cut(training_rows(docs, labels, label, sample))
    words, shapes = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = TokenCodes(), np.zeros((WORDS, DIM), np.float32)
        for batch in batches:
            for text in batch.column(0):
                neighbours(codes.of(text.as_py()), words, shapes, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    total = np.zeros((WORDS, DIM), np.float32)
    for r in rows.select("text").mapInArrow(add_up, "part binary").collect():  # one array of fixed size for each of eight partitions
        total += np.frombuffer(r["part"], np.float32).reshape(WORDS, DIM)
    vectors = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = TokenCodes()
        for batch in batches:
            x = [features(codes.of(t.as_py()), vectors, shapes).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "y"])

    got = sorted((r["x"], r["y"]) for r in rows.mapInArrow(pool, "x binary, y int").collect())  # `sample` rows of fixed size, in a set order
    x = np.array([np.frombuffer(a, np.float32) for a, _ in got], np.float32).reshape(-1, FEATURES)
    return Model(vectors, shapes, fitted(x, np.array([b for _, b in got], np.float64)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`. Null and empty texts get the score of a text without words; repeated
    rows get equal scores; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, own = TokenCodes(), shared.value
        for batch in batches:
            x = np.array([features(codes.of(t.as_py()), own.vectors, own.shapes) for t in batch.column(1)], np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.network.scores(x), pa.float64())], names=["doc_id", "score"])

    held_out = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return intake(docs).mapInArrow(score, "doc_id long, score double").select("doc_id", held_out, "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes, own = TokenCodes(), shared.value
        for texts in frames:
            x = np.array([features(codes.of(t or ""), own.vectors, own.shapes) for t in texts], np.float32).reshape(-1, FEATURES)
            yield pd.Series(own.network.scores(x))

    return docs.where(quality(F.coalesce(F.col("text"), F.lit(""))) >= PREDICTED_FROM)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, trained(docs, labels))
