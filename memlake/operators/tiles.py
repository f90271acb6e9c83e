"""All pairs of rows of a block by pairs of tiles: a row goes to one tile, which is packed into one row, and a task meets pairs of tiles as a
product reads them. So a set is shuffled once, however many tiles its own meets, and no pair is shuffled.

Sets come as 64-bit hashes of their tokens. Within a pair of tiles the order of tokens, from the rarest on, is the task's own, so nothing is
counted over all rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.lineage import cut

#: Weight of a tile at most (a set weighs its tokens and `ROW`), the tiles that a block is cut into at least if they are not below `SMALL`.
TILE, ROW, LEAST_TILES, SMALL = 1 << 22, 64, 6, 1 << 16
#: Pairs that are looked at together, and rows of a strip.
TOGETHER, STRIP = 1 << 22, 512
#: Partitions that small and that any number of tiles are read in at most (their product has the square of it); rows of (block, n) that are broadcast.
FEW, MOST, PLACES = 16, 100, 200_000


def dealt(rows: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """`rows` (block, id, n, tokens, and flags) as pairs of tiles of a block that may hold sets of the size ratio `least`, one a row: x and
    y, packed tiles; y is null where a tile meets itself. Tiles are ranges of n."""
    weight = F.col("n") + ROW
    sizes = rows.groupBy("block", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("c") * weight).over(Window.partitionBy("block"))
    most = F.least(F.lit(tile), F.greatest(F.lit(min(SMALL, tile)), F.ceil(total / LEAST_TILES)))
    placed = cut(sizes.select("block", "n", "c", F.coalesce(F.sum(F.col("c") * weight).over(before), F.lit(0)).alias("from"), most.alias("most"), total.alias("total")))
    seen = placed.agg(F.count("*").alias("places"), F.sum(F.col("c") * weight / F.col("most")).alias("tiles"), F.sum(F.col("c") * weight / TILE).alias("full")).first()
    places = F.broadcast(placed) if seen["places"] <= PLACES else placed
    at = F.floor((F.col("from") + F.pmod(F.xxhash64("id"), F.col("c")) * weight) / F.col("most")).cast("int")
    own = rows.join(places, ["block", "n"]).withColumn("t", at).drop("c", "from", "most", "total")
    n = int(seen["tiles"] or 0) + 1
    flags = [c for c in rows.columns if c not in ("block", "id", "n", "tokens")]
    # explicit, so that tiles stay apart, however few bytes they are
    packed = own.repartition(min(4000, n), "block", "t").groupBy("block", "t").applyInArrow(packing(flags), f"block {dict(rows.dtypes)['block']}, t int, low int, high int, tile binary")
    tiles = cut(packed).coalesce(min(n, max(FEW, int(seen["full"] or 0)), MOST))
    side = lambda x: tiles.select(*[F.col(c).alias(f"{c}_{x}") for c in tiles.columns])
    # of the two orders of a pair the parity chooses one, so that both halves of the product have work
    once = F.expr("t_x = t_y OR (t_x < t_y) = ((t_x + t_y) % 2 = 0)")
    near = F.least("high_x", "high_y") >= F.greatest("low_x", "low_y") * least - 1e-9
    pairs = side("x").hint("shuffle_replicate_nl").join(side("y"), F.col("block_x").eqNullSafe(F.col("block_y")) & once & near)
    return pairs.select(F.col("tile_x").alias("x"), F.when(F.col("t_x") != F.col("t_y"), F.col("tile_y")).alias("y"))


def packing(flags: list[str]) -> Callable[[pa.Table], pa.Table]:
    """For `applyInArrow`: the sets of a tile as one row, tokens as places in the tile's own vocabulary."""

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        lists = rows["tokens"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        vocabulary, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        n = rows["n"].to_numpy()
        columns = {"id": rows["id"].to_numpy(), "n": n.astype(np.int64), "vocabulary": vocabulary, "code": code.astype(np.int32)}
        columns |= {f: rows[f].to_numpy().astype(np.int8) for f in flags}
        batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns.values()], names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        own = [rows["block"].slice(0, 1).combine_chunks(), rows["t"].slice(0, 1).combine_chunks(), pa.array([n.min()], pa.int32()), pa.array([n.max()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.Table.from_arrays(own, names=["block", "t", "low", "high", "tile"])

    return packed


def compared(pairs: DataFrame, compare: Callable[[Sets, Sets], pa.RecordBatch], schema: str) -> DataFrame:
    """What `compare` finds in each of the `dealt` pairs of tiles."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                left = Sets(x.as_buffer())
                yield compare(left, Sets(y.as_buffer()) if y.is_valid else left)

    return pairs.mapInArrow(look, schema)


class Sets:
    """The sets of a tile by id: ids, sizes, starts, and their tokens as ranks of a common order."""

    def __init__(self, tile: pa.Buffer):
        batch = pa.ipc.open_stream(tile).read_next_batch()
        columns = {name: c.flatten().to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns, strict=True)}
        self.id, self.n, self.vocabulary, self.code = (columns.pop(name) for name in ("id", "n", "vocabulary", "code"))
        self.flags = {name: c.astype(bool) for name, c in columns.items()}
        self.start = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def ranked(self, rank: np.ndarray) -> None:
        key = np.sort(self.row << 32 | rank[self.code])
        self.rank = key & 0xFFFFFFFF

    def prefix(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, rank) of so many first tokens of each set."""
        keep = np.arange(len(self.rank)) - self.start[self.row] < lengths[self.row]
        return self.row[keep], self.rank[keep]


def common_order(x: Sets, y: Sets) -> int:
    """Ranks the tokens of both from the rarest on; how many there are."""
    every = x.vocabulary if x is y else np.union1d(x.vocabulary, y.vocabulary)
    count = np.zeros(len(every), np.int64)
    places = []
    for s in (x,) if x is y else (x, y):
        places.append(np.searchsorted(every, s.vocabulary))
        count[places[-1]] += np.bincount(s.code, minlength=len(s.vocabulary))
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(every))
    for s, place in zip((x, y), places):
        s.ranked(rank[place])
    return len(every)


def met(row: np.ndarray, rank: np.ndarray, other: tuple[np.ndarray, np.ndarray], vocabulary: int, n_rows: int, strip: int = STRIP):
    """(first row, behind the last, row, other row) by strips: the entries of a side, by row, with each of the other's of the same token;
    `TOGETHER` at a time unless one row has more."""
    order = np.argsort(other[1], kind="stable")
    holders = other[0][order]
    count = np.bincount(other[1], minlength=vocabulary)
    start = np.cumsum(count) - count
    work = np.concatenate([[0], np.cumsum(np.bincount(row, weights=count[rank], minlength=n_rows).astype(np.int64))])
    edge = np.searchsorted(row, np.arange(n_rows + 1))
    lo = 0
    while lo < n_rows:
        hi = max(lo + 1, min(lo + strip, n_rows, int(np.searchsorted(work, work[lo] + TOGETHER, side="right")) - 1))
        r, k = row[edge[lo] : edge[hi]], rank[edge[lo] : edge[hi]]
        c = count[k]
        each = np.arange(int(c.sum())) + np.repeat(start[k] - (np.cumsum(c) - c), c)
        yield lo, hi, np.repeat(r, c), holders[each]
        lo = hi


def wanted(x: Sets, y: Sets, r: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Which pairs of rows have an asked and a stored one; all, if sets have no flags."""
    if not x.flags:
        return np.ones(len(r), bool)
    return x.flags["asked"][r] & y.flags["stored"][o] | x.flags["stored"][r] & y.flags["asked"][o]


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def similar(least: float):
    """For `compared`: (a, b, similarity), a < b, at `least` or more; over sets with the flags `asked` and `stored`, each a is asked and b stored.

    Similar sets of n and m tokens share least / (1 + least) of n + m. Of these all but those behind the prefix that ends first lie in both
    prefixes, so a pair is verified only if it has so many there.
    """

    def found(x: Sets, y: Sets) -> pa.RecordBatch:
        vocabulary = common_order(x, y)
        behind = [np.ceil(s.n * least - 1e-9).astype(np.int64) - 1 for s in (x, y)]
        (row, rank), other = x.prefix(x.n - behind[0]), y.prefix(y.n - behind[1])
        holds = np.zeros(vocabulary, bool)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi, r, o in met(row, rank, other, vocabulary, len(x.n)):
            keep = (r < o if x is y else np.ones(len(r), bool)) & wanted(x, y, r, o) & (np.minimum(x.n[r], y.n[o]) >= np.maximum(x.n[r], y.n[o]) * least - 1e-9)
            at = (r[keep] - lo) * len(y.n) + o[keep]
            if (hi - lo) * len(y.n) < 8 * len(at):
                shared = np.bincount(at, minlength=(hi - lo) * len(y.n))
                at = np.flatnonzero(shared)
                shared = shared[at]
            else:
                at, shared = np.unique(at, return_counts=True)
            r, o = at // len(y.n) + lo, at % len(y.n)
            need = np.ceil((x.n[r] + y.n[o]) * (least / (1 + least)) - 1e-9) - np.maximum(behind[0][r], behind[1][o])
            r, o = r[shared >= need], o[shared >= need]
            for k, first, last in zip(*_runs(r), strict=True):
                partners = o[first:last]
                own = x.rank[x.start[k] : x.start[k] + x.n[k]]
                holds[own] = True
                sizes = y.n[partners]
                for some in np.split(np.arange(len(partners)), np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1):
                    n = sizes[some]
                    starts = np.cumsum(n) - n
                    tokens = y.rank[np.arange(int(n.sum())) + np.repeat(y.start[partners[some]] - starts, n)]
                    both = np.add.reduceat(holds[tokens].astype(np.int64), starts)
                    similarity = both / (x.n[k] + n - both)
                    near = similarity >= least
                    ids = y.id[partners[some][near]]
                    own_id = np.full(len(ids), x.id[k])
                    if not x.flags:
                        out.append((np.minimum(ids, own_id), np.maximum(ids, own_id), similarity[near]))
                        continue
                    for a, b, way in ((own_id, ids, x.flags["asked"][k] & y.flags["stored"][partners[some][near]]), (ids, own_id, x.flags["stored"][k] & y.flags["asked"][partners[some][near]])):
                        out.append((a[way], b[way], similarity[near][way]))
                holds[own] = False
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=PAIRS)

    return found


def _runs(sorted_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values with where each begins and ends."""
    first = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
    return sorted_rows[first], first, np.append(first, len(sorted_rows))[1:]


BEST = pa.schema([("id", pa.int64()), ("similarity", pa.float64())])
#: From this product of both sides' shares of holders on a token is multiplied as a column, below its holders are met one by one.
DENSE = 0.004


def best(x: Sets, y: Sets) -> pa.RecordBatch:
    """For `compared` over sets with the flags `asked` and `stored`: (id, similarity), the highest similarity of each asked set with
    another stored one of the two tiles, if it is above 0. Overlaps are complete: common tokens by a product of matrices, the rest by their holders."""
    vocabulary = common_order(x, y)
    counts = [np.bincount(s.rank, minlength=vocabulary) for s in (x, y)]
    common = np.flatnonzero(counts[0] * counts[1] >= DENSE * len(x.n) * len(y.n))
    column = np.full(vocabulary, -1, np.int64)
    column[common] = np.arange(len(common))

    def split(s: Sets) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        c = column[s.rank]
        return s.row[c >= 0], c[c >= 0], (s.row[c < 0], s.rank[c < 0])

    def matrix(row: np.ndarray, c: np.ndarray, lo: int, hi: int) -> np.ndarray:
        m = np.zeros((hi - lo, max(1, len(common))), np.float32)
        first, last = np.searchsorted(row, [lo, hi])
        m[row[first:last] - lo, c[first:last]] = 1
        return m

    (row, c, rare), (other_row, other_c, other_rare) = split(x), split(y)
    asked, stored = ([s.flags[name] for s in (x, y)] for name in ("asked", "stored"))
    found = [np.zeros(len(x.n)), np.zeros(len(y.n))]
    width = max(1, (1 << 25) // max(1, len(common)))
    bands = [(lo, min(lo + width, len(y.n))) for lo in range(0, len(y.n), width)]
    dense = [matrix(other_row, other_c, *b) for b in bands] if len(bands) <= 4 else None
    for lo, hi, r, o in met(*rare, other_rare, vocabulary, len(x.n), 256):
        both = np.bincount((r - lo) * len(y.n) + o, minlength=(hi - lo) * len(y.n)).astype(np.float64).reshape(hi - lo, len(y.n))
        own = matrix(row, c, lo, hi)
        for k, b in enumerate(bands):
            both[:, b[0] : b[1]] += own @ (dense[k] if dense else matrix(other_row, other_c, *b)).T
        both /= x.n[lo:hi, None] + y.n - both
        if x is y:
            both[np.arange(hi - lo), np.arange(lo, hi)] = 0
        if stored[1].any():
            found[0][lo:hi] = np.maximum(found[0][lo:hi], both[:, stored[1]].max(1))
        if stored[0][lo:hi].any():
            found[1] = np.maximum(found[1], both[stored[0][lo:hi]].max(0))
    ids, similarity, wanted = (np.concatenate(p) for p in ((x.id, y.id), found, asked))
    keep = wanted & (similarity > 0)
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(similarity[keep])], schema=BEST)
