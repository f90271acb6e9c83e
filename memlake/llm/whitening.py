"""Whitening of embeddings by hierarchical SVD: partitions keep all singular values, vectors and exact sums; merges lose nothing.

A state stands for a set of vectors: their number, their sums per dimension (exact integers), and the singular values and right vectors of
the centred vectors. Two states merge by stacking `diag(s) V` of both and one row that corrects for the different means, and one more SVD.
No rank is cut anywhere, so the last state is the SVD of all the vectors, up to rounding. Covariances are never summed up, whose squares
would cost half the digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_table

STATE = "part long, n long, sums array<string>, singular array<double>, vectors array<double>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: States merged in one task. A state is a square of the dimension, so a task holds so many squares.
FAN_IN = 8
#: Vectors of a partition whose SVD is taken at once, at least; wider vectors take four times their dimension.
BLOCK = 4096


class State:
    """Number, exact sums, singular values and right vectors (k x d) of the centred vectors of a set."""

    def __init__(self, n: int, sums: list[int], singular: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.singular, self.vectors = n, sums, singular, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        """The state of the rows of `x` (long). Sums are exact: the halves of each number are added apart."""
        high, low = x >> 32, x & 0xFFFFFFFF
        sums = [(int(h) << 32) + int(k) for h, k in zip(high.sum(0), low.sum(0), strict=True)]
        centred = x - np.array([s / len(x) for s in sums])
        if len(centred) > 2 * centred.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        _, singular, vectors = np.linalg.svd(centred, full_matrices=False)
        return cls(len(x), sums, singular, vectors)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def merged(self, other: State) -> State:
        """Both sets as one: the mean-correction row carries what lies between their means."""
        correction = np.sqrt(self.n * other.n / (self.n + other.n)) * (self.mean() - other.mean())
        stacked = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, correction])
        _, singular, vectors = np.linalg.svd(stacked, full_matrices=False)
        return State(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], singular, vectors)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": [str(s) for s in self.sums], "singular": self.singular.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def read(cls, row) -> State:
        singular = np.array(row["singular"], float)
        return cls(int(row["n"]), [int(s) for s in row["sums"]], singular, np.array(row["vectors"], float).reshape(len(singular), -1))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def partial_states(dim: int):
    """One state for each partition that has vectors, built block after block, so that a task holds one block and one state."""
    least = max(BLOCK, 4 * dim)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, rows = None, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column(0), dim))
                rows += batch.num_rows
            if rows >= least:
                new = State.of(np.vstack(held))
                state, held, rows = state.merged(new) if state else new, [], 0
        if held:
            new = State.of(np.vstack(held))
            state = state.merged(new) if state else new
        if state:
            out = state.row(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_pylist([out], pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("singular", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]))

    return states


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    state, part = None, int(rows["part"].iloc[0]) // FAN_IN
    for row in rows.sort_values("part").to_dict("records"):
        state = state.merged(State.read(row)) if state else State.read(row)
    return pd.DataFrame([state.row(part)])


def fitted(fit: DataFrame, dim: int) -> State | None:
    """The state of all vectors of `fit` (x array<long>, each of `dim` entries), merged in a tree of FAN_IN branches; None if there are none.
    Only the last state, of `dim` squared numbers, reaches the driver."""
    states = cut_table(fit.select("x").mapInArrow(partial_states(dim), STATE))
    parts = states.agg(F.max("part")).first()[0]
    if parts is None:
        return None
    while parts:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_merge, STATE)
        parts //= FAN_IN
    return State.read(states.first())


class Whitening:
    """What a fit gives: n, S, the leading unit eigenvectors (rows), their eigenvalues, and the trace of the covariance."""

    def __init__(self, state: State, components: int):
        values = state.singular**2 / state.n
        self.n, self.sums, self.mean = state.n, state.sums, state.mean()
        dim = len(self.mean)
        k = min(components, dim)
        self.trace = float(values.sum())
        padded = np.zeros(k)
        padded[: len(values[:k])] = values[:k]
        vectors = np.zeros((k, dim))
        vectors[: len(state.vectors[:k])] = state.vectors[:k]
        # Directions without variance: what is left there is rounding.
        self.flat = np.sqrt(padded) <= np.sqrt(max(values.max(initial=0.0), 0.0)) * dim * np.finfo(float).eps * 8
        self.values, self.vectors = np.where(self.flat, 0.0, padded), vectors
        scale = np.where(self.flat, 0.0, 1 / np.sqrt(np.where(self.flat, 1.0, padded)))
        self.projection = vectors.T * scale
        self.explained = self.values / self.trace if self.trace else np.zeros(k)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; null where it passes a long."""
        most = int(np.abs(x).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        sums = [int(s) for s in self.sums]
        exact = (sum((self.n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def _identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, measured over its rows. Directions
    without variance are left out."""
    live = np.flatnonzero(~model.flat)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column(0), dim))[:, live]
                first += w.sum(0)
                second += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(live) * (len(live) + 1)), "v": np.concatenate([first, second.ravel()])})

    if not len(live):
        return 0.0
    sums = fit.select("x").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    found = np.array([r["v"] for r in sums]) / model.n
    first, second = found[: len(live)], found[len(live) :].reshape(len(live), len(live))
    return float(np.abs(second - np.outer(first, first) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on the leading components of the distinct ones.

    A vector that is null or holds null or non-finite entries is left out. Entries become x = floor(scale * c), in double, as a long (at
    the ends of the range where it does not fit). The fit list is each distinct x once, so copies, however many, weigh as one; each row
    gets its result, repeated rows and null ids too. Vectors of another length than most of the fit list have (the longer on a tie) and
    empty ones cannot be compared and are left out as well. There are min(components, dimension) components. One without variance has
    whitened and explained 0.0 and is left out of identity_error. `deviation` is null where it passes a long. Other columns are left
    behind; an empty table gives no rows. Ties of eigenvalues leave the choice of basis open, as for any eigenvectors.

    A partition's vectors make one state; the states merge in a tree. The model (dimension squared numbers) is all that the driver sees.
    """
    spark = vectors.sparkSession
    entries = F.col("v")
    real = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(entries, lambda c: F.floor(c * float(scale)).cast("long"))
    doubles = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("v")).where(entries.isNotNull() & real & (F.size(entries) > 0)).select("vec_id", whole.alias("x"))
    fit = cut_table(rows.select("x").distinct())
    common = fit.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dim = common["dim"]
    fit = fit.where(F.size("x") == dim)
    model = Whitening(fitted(fit, dim), components)
    error = _identity_error(fit, dim, model)
    k = len(model.values)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), dim)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(at)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == dim).mapInArrow(applied, RESULT)
