"""What several training-data operators share: column intake, cut lineage and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intake(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text is the empty text. Other columns, whatever their names, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which the session names in spark.checkpoint.dir. One of our own only in local mode, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="memlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, so that a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As `cut`, but as a Parquet table: smaller for wide tables of numbers, and read by columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def small_broadcast(df: DataFrame, most: int, list_col: str | None = None) -> DataFrame:
    """`df` (narrow, and cut, as it is counted here) with a broadcast hint if it has at most `most` rows, or, with a column of lists, at
    most so many items of lists, a row counting as four; else as it is, to be shuffled."""
    held = df.count() if list_col is None else df.agg(F.coalesce(F.sum(F.size(list_col) + 4), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df


class BitTable:
    """Which of the long numbers `ids` (not negative) of `df` may be there, as bits: a number that is there is never missed; others are taken for
    one with a chance of 1 / `spare`, more if the table needed more than `most` bits. Spark gathers the bits, the driver gets the table."""

    def __init__(self, df: DataFrame, id_col: str = "id", spare: int = 64, most: int = 1 << 29):
        wanted = min(most, max(1 << 16, df.count() * spare))
        self.modulus = int((1 << (wanted - 1).bit_length()) * 0.618) | 1  # no multiple or neighbour of a power of two, which ids are made with
        at = F.col(id_col) % self.modulus
        placed = df.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(32767).alias("at")).repartition("block")
        found = placed.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
        table = np.zeros(((self.modulus >> 15) + 1, 4096), np.uint8)
        for block, bits in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
            table[block] = np.frombuffer(bits, np.uint8)
        self.table = table.ravel()

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = ids % self.modulus
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def hash_sample(df: DataFrame, wanted: int, *by: str) -> DataFrame:
    """About `wanted` rows of `df`, all if it has no more: those with the least hashes of the columns `by`, by a threshold taken from a
    count, so that nothing is sorted or gathered."""
    n = df.count()
    return df if n <= wanted else df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int((1 << 40) * wanted / n))


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand. It is emptied at `bound` entries, so memory stays flat on any vocabulary."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = value
        return value

    def of(self, words: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of word hashes become evenly spread values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[str], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words. Fewer words than that are one shingle; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words, len(words))
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        total = mixed(total + h[k : k + n] + np.uint64(k + 1))
    return np.unique(total)
