"""The memory audit: pairs of records with close vectors, which of them to retire, and what to suggest.

The pairs are exact. Vectors of a block are dealt into tiles, and each pair of tiles is one piece of work: sixteen leading dimensions and the
length of the rest bound a cosine from above, and only pairs that the bound leaves are computed. No task holds more than two tiles, and what
comes out are pairs above the threshold only. Equal vectors are compared once.

Retiring is sequential by its nature: the most similar pair first, and each decision may protect or free others. Pairs that share neither a
record nor a question's answer cannot touch each other, so every round decides all pairs that come first among those they could touch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.lineage import cut

#: From where on a pair is a duplicate to retire, and one to suggest; days until a status note or an unused record is named.
EXACT, NEAR = 0.95, 0.85
STATUS_NOTE_DAYS, UNUSED_DAYS = 14, 28
TILE, HEAD = 2048, 16
#: A block of many vectors has wider tiles, up to this, so that a vector goes to few of them; rows and pairs that are looked at together; products of a partition.
WIDEST, TILES, STRIP, TOGETHER, PRODUCTS = 4096, 16, 256, 1 << 16, 1 << 22


def _above(least: float):
    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["side"] == s] for s in (0, 1)]
        (a, x), (b, y) = ((own["id"].to_numpy(), np.array(own["unit"].tolist(), float)) for own in sides)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        rest = [np.sqrt(np.maximum(0, 1 - (v[:, :HEAD] ** 2).sum(1))) for v in (x, y)]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for lo in range(0, len(a), STRIP):
            own = slice(lo, lo + STRIP)
            i, j = np.nonzero(x[own, :HEAD] @ y[:, :HEAD].T + rest[0][own, None] * rest[1] >= least - 1e-9)
            i += lo
            keep = (a[i] < b[j]) if rows["same"].iloc[0] else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            for k in range(0, len(i), TOGETHER):
                p, q = i[k : k + TOGETHER], j[k : k + TOGETHER]
                near = np.round(np.einsum("ij,ij->i", x[p], y[q]), 9)
                p, q, near = p[near >= least], q[near >= least], near[near >= least]
                out.append((np.minimum(a[p], b[q]), np.maximum(a[p], b[q]), near))
        return pd.DataFrame(dict(zip(("a", "b", "similarity"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return compared


def cosine_pairs(vectors: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of `vectors` (id long, block, embedding) of a block whose cosine is `least` or more, to nine
    places; vectors without length have none. Each set of equal vectors is compared by its least id, and its others pair with that one."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    own = vectors.select("id", "block", F.transform("embedding", lambda c: c.cast("double")).alias("v")).withColumn("length", length).where("length > 0")
    unit = cut(own.select("id", "block", "v", F.transform("v", lambda c: c / F.col("length")).alias("unit")))
    first = cut(unit.groupBy("block", "v").agg(F.min("id").alias("id"), F.first("unit").alias("unit")))
    copies = unit.select("block", "v", F.col("id").alias("b")).join(first.select("block", "v", F.col("id").alias("a")), ["block", "v"]).where("a != b").select("a", "b", F.lit(1.0).alias("similarity"))
    # no block has fewer tiles than it has with `tile`, unless there are more than `TILES`
    tiles = first.groupBy("block").agg(F.ceil(F.count("*") / F.greatest(F.lit(tile), F.least(F.lit(WIDEST), F.ceil(F.count("*") / TILES)))).cast("int").alias("tiles"), F.count("*").alias("vectors"))
    dealt = first.join(tiles, "block").select("block", "id", "unit", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("t"), "tiles")
    mine = dealt.select("block", "id", "unit", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    work = mine.select("block", "id", "unit", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), (F.col("t") > F.col("u")).cast("int").alias("side"), (F.col("t") == F.col("u")).alias("same"))
    twice = work.where("same").withColumn("side", F.lit(1))
    pieces = tiles.agg(F.sum(F.expr("tiles * (tiles + 1L) / 2")), F.ceil(F.sum(F.expr("vectors * double(vectors)")) / PRODUCTS)).first()
    # explicit, so that heavy pairs of tiles stay apart, however few bytes they are
    found = work.unionByName(twice).repartition(int(max(1, min(pieces[0] or 1, pieces[1] or 1, 2000))), "block", "i", "j").groupBy("block", "i", "j").applyInPandas(_above(least), "a long, b long, similarity double")
    return found.unionByName(copies)


def retirements(pairs: DataFrame, records: DataFrame, carriers: DataFrame) -> DataFrame:
    """(kind, drop, keep, similarity): what becomes of each pair at EXACT or more, the most similar first, then by ids.

    `pairs`: a, b, similarity. `records`: id, standing (a struct; the greater stays, the first on a tie). `carriers`: question, project_id,
    id of the records that answer a question. RETIRED, or DUPLICATE_PROTECTED where both are the last active carrier of an answer in their
    project; if the lesser one is, the other goes. Pairs with a retired record are void.
    """
    left, right = (records.select(F.col("id").alias(c), F.col("standing").alias(f"{c}_standing")) for c in ("a", "b"))
    met = pairs.where(F.col("similarity") >= EXACT).join(left, "a").join(right, "b")
    first = F.col("a_standing") >= F.col("b_standing")
    pending = cut(met.select("a", "b", "similarity", F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.struct((-F.col("similarity")).alias("s"), "a", "b").alias("order")))
    answers = carriers.select(F.concat_ws("/", "question", "project_id").alias("answer"), "id")
    involved = pending.select(F.col("a").alias("id")).union(pending.select("b")).distinct()
    answers = cut(answers.join(answers.join(involved, "id", "left_semi").select("answer").distinct(), "answer", "left_semi"))
    out = None
    while pending.limit(1).count():
        ids = pending.select("order", F.explode(F.array(F.col("a"), F.col("b"))).alias("id"))
        touched = ids.select("order", F.concat(F.lit("r"), F.col("id").cast("string")).alias("thing")).union(ids.join(answers, "id").select("order", F.concat(F.lit("q"), "answer")).distinct())
        turn = touched.groupBy("thing").agg(F.min("order").alias("first"))
        due = touched.join(turn, "thing").groupBy("order").agg(F.min((F.col("order") == F.col("first")).cast("int")).alias("due")).where("due = 1").select("order")
        last = answers.groupBy("answer").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id").distinct()
        now = pending.join(due, "order", "left_semi").join(last.select(F.col("id").alias("drop"), F.lit(True).alias("guarded")), "drop", "left").join(last.select(F.col("id").alias("keep"), F.lit(True).alias("other_guarded")), "keep", "left")
        swap = F.col("guarded").isNotNull()
        decided = cut(now.select("order", F.when(swap & F.col("other_guarded").isNotNull(), "DUPLICATE_PROTECTED").otherwise("RETIRED").alias("kind"), F.when(swap, F.col("keep")).otherwise(F.col("drop")).alias("drop"), F.when(swap, F.col("drop")).otherwise(F.col("keep")).alias("keep"), "similarity"))
        gone = decided.where("kind = 'RETIRED'").select(F.col("drop").alias("id"))
        pending = cut(pending.join(decided.select("order"), "order", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
        answers = cut(answers.join(gone, "id", "left_anti"))
        rows = decided.select("kind", "drop", "keep", "similarity")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else pending.select(F.lit("RETIRED").alias("kind"), "drop", "keep", "similarity")


def audit(records: DataFrame, vectors: DataFrame, holds: dict[str, Column], status_note: Column, as_of: int, tile: int = TILE) -> DataFrame:
    """(kind, memory_id, other_id, similarity) over active records: what `retirements` gives, NEAR_DUPLICATE pairs of what is left,
    STALE_STATUS_NOTE observations, and NEVER_DELIVERED ones that no question needs.

    `records`: id, memory_id, project_id, type, content, at_s, used, delivered. `vectors`: id, embedding. Pairs are within a project.
    """
    live = cut(records.select("id", "memory_id", "project_id", "type", "at_s", "used", "delivered", F.length("content").alias("n"), status_note.alias("note"), F.array_compact(F.array(*[F.when(c, F.lit(q)) for q, c in holds.items()])).alias("answers")))
    standing = live.select("id", F.struct("used", "delivered", "at_s", "n").alias("standing"))
    carriers = live.select(F.explode("answers").alias("question"), F.coalesce("project_id", F.lit("")).alias("project_id"), "id")
    pairs = cut(cosine_pairs(vectors.join(live.select("id", F.coalesce("project_id", F.lit("")).alias("block")), "id"), NEAR, tile))
    done = retirements(pairs, standing, carriers)
    gone = cut(done.where("kind = 'RETIRED'").select(F.col("drop").alias("id")))
    near = pairs.where(F.col("similarity") < EXACT).join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
    a, b = (standing.select(F.col("id").alias(c), F.col("standing").alias(f"{c}_s")) for c in ("a", "b"))
    first = F.col("a_s") >= F.col("b_s")
    near = near.join(a, "a").join(b, "b").select(F.lit("NEAR_DUPLICATE").alias("kind"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), "similarity")
    both = done.unionByName(near)
    name = lambda c: live.select(F.col("id").alias(c), F.col("memory_id").alias(f"{c}_id"))
    found = both.join(name("drop"), "drop").join(name("keep"), "keep").select("kind", F.col("drop_id").alias("memory_id"), F.col("keep_id").alias("other_id"), F.round("similarity", 3).alias("similarity"))
    left = live.join(gone, "id", "left_anti")
    days = (F.lit(as_of) - F.col("at_s")) / 86400
    sole = carriers.groupBy("question", "project_id").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").select("id").distinct()
    alone = lambda kind, df: df.select(F.lit(kind).alias("kind"), "memory_id", F.lit("").alias("other_id"), F.lit(0.0).alias("similarity"))
    notes = left.where((F.col("type") == "observation") & (days >= STATUS_NOTE_DAYS) & F.col("note"))
    unused = left.where((days >= UNUSED_DAYS) & (F.coalesce("delivered", F.lit(0)) == 0)).join(sole, "id", "left_anti")
    return found.unionByName(alone("STALE_STATUS_NOTE", notes)).unionByName(alone("NEVER_DELIVERED", unused))
