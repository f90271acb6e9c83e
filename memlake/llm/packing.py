"""Best-fit packing of tokenised documents into sequences of a fixed length.

The packing depends on piece lengths alone, so it is planned on their histogram (at most `capacity` numbers, whatever the size of the
corpus) and carried out by ranking the pieces of each length. A planned bin stands for as many sequences as the counts allow: each
step uses up a length or nearly so, and the plan stays a few thousand rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, intake

CAPACITY = 2048
#: Pieces of one length that one task ranks at most, on average.
RANKED_TOGETHER = 1 << 15
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: A run of letters whose lower case is one letter each, then marks that the tokeniser keeps together.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?#$%&*]*)")


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip((b for b in range(256) if b not in plain), range(256, 512), strict=False))


class ChunkIds(dict):
    """Text between spaces -> its ids as little-endian 32-bit bytes.

    The tokeniser never merges across white space, nor letters with marks, so a document's ids are those of its chunks, and a plain
    chunk's are those of its lower-case letters and of its marks. Memory is bounded: a dictionary that is full starts anew, and long
    chunks are not kept.
    """

    def __init__(self, path: str, bound: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.bound, self.parts = Tokenizer.from_file(path), bound, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        """The ids of lower-case letters only, or of marks only: the merges alone, as nothing is left to normalise or split."""
        if (ids := self.parts.get(text)) is None:
            if len(self.parts) >= 2 * self.bound:
                self.parts.clear()
            spelt = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[text] = array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 48:
            return self.encoded(chunk)
        plain = PLAIN.fullmatch(chunk)
        ids = self.part(plain[1].lower()) + (self.part(plain[2]) if plain[2] else b"") if plain else self.encoded(chunk)
        if len(self) >= self.bound:
            self.clear()
        self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row per piece (`PIECES`): a document's ids, then `end_id`, cut after every `capacity` ids.

    A null or empty text has the one id `end_id`. Repeated rows give repeated pieces.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = ChunkIds(tokenizer_path), array("I", [end_id]).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = chunks.of(text.as_py()) + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return intake(docs).mapInArrow(cut_up, PIECES)


def two_tighter(left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two lengths a >= b still unpacked (`left`: how many of each) with the largest a + b in (least, room]; None if there are none."""
    free = left[: room + 1] > 0
    at = np.flatnonzero(free)
    if not len(at):
        return None
    below = np.maximum.accumulate(np.where(free, np.arange(room + 1), 0))
    partner = below[room - at]
    own = (partner == at) & (left[at] < 2)
    partner[own] = below[at[own] - 1]
    total = np.where(partner > 0, at + partner, 0)
    k = int(total.argmax())
    return (max(int(at[k]), int(partner[k])), min(int(at[k]), int(partner[k]))) if total[k] > least else None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit on a histogram: [([(length, copies), ...], sequences of this kind), ...].

    Each bin is filled greedily, the largest piece that fits first; then its smallest piece makes room for two unpacked ones if they
    fit the expanded gap more tightly.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    there, plan = sorted(counts), []
    while there:
        used: Counter[int] = Counter()
        gap, k = capacity, len(there) - 1
        while (k := min(k, bisect_right(there, gap) - 1)) >= 0:
            n = min(gap // there[k], int(left[there[k]]))
            used[there[k]] += n
            gap, k = gap - n * there[k], k - 1
        if gap and used.total() > 1:
            smallest = min(used)
            rest = left.copy()
            for length, n in used.items():
                rest[length] -= n
            if pair := two_tighter(rest, gap + smallest, smallest):
                used[smallest] -= 1
                used.update(pair)
        used = +used
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                there.remove(length)
        plan.append((sorted(used.items(), reverse=True), times))
    return plan


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """What each rank of each length gets: from rank `lo` on, `copies` pieces a sequence, the first sequence and offset."""
    taken: Counter[int] = Counter()
    rows, first = [], 0
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], copies, first, offset))
            taken[length] += copies * times
            offset += copies * length
        first += times
    return pd.DataFrame(rows, columns=["length", "lo", "copies", "first", "offset"]).sort_values(["length", "lo"], ignore_index=True)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (`PIECES`; they must come out the same when read again) with sequence_id and offset, gapless from 0 in each sequence.

    Two full pieces never share a sequence, equal rows are interchangeable, and an empty input gives an empty result.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    layout = slots(plan_bins(counts, capacity))
    shares = F.lit(np.array([1] + [max(1, -(-counts.get(k, 0) // RANKED_TOGETHER)) for k in range(1, capacity + 1)], dtype=np.int32))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(shares, (F.col("length") + 1).cast("int"))))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each length and RANKED_TOGETHER pieces: bounded by the histogram above.
    starts = dealt.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "share"])
    keys = layout["length"].to_numpy(np.int64) << 40 | layout["lo"].to_numpy(np.int64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            at = np.searchsorted(keys, x["length"].to_numpy() << 40 | x["rank"].to_numpy(), side="right") - 1
            own = layout.iloc[at].reset_index(drop=True)
            nth = x["rank"].to_numpy() - own["lo"].to_numpy()
            x["sequence_id"] = own["first"].to_numpy() + nth // own["copies"].to_numpy()
            x["offset"] = own["offset"].to_numpy() + nth % own["copies"].to_numpy() * x["length"].to_numpy()
            yield x.drop(columns="rank")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ready = ranked.select(*columns, (F.col("rank") + F.col("ranked_before")).cast("long").alias("rank"))
    return ready.mapInPandas(place, PIECES + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(cut(tokenised_pieces(docs, tokenizer_path, capacity)), capacity)
