"""Exact set-similarity pairs, for token sets within a block (a type, a project)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.lineage import cut, cut_table

from . import tiles

#: Ids of copies that are broadcast; more are joined by a shuffle.
COPIES = 2_000_000


def keyed(records: DataFrame, *flags: str) -> DataFrame:
    """`records` (id, block, tokens sorted and distinct, and flags) as (id, block, key, n, tokens), written once: key tells their sets
    apart, n is their size, tokens are 64-bit hashes. Empty sets are kept."""
    key = F.sha2(F.array_join("tokens", " "), 256).alias("key")
    return cut_table(records.select("id", "block", key, F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), *flags))


def copies_of(rows: DataFrame) -> DataFrame:
    """(first, id): each of the `keyed` rows whose set an earlier one of the block has. Linear in the size of a group of copies."""
    own = rows.where("n > 0").select("block", "id", "key")
    first = own.groupBy("block", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("block", "key", "first")
    return cut(own.join(first, ["block", "key"]).where("id != first").select("first", "id"))


def first_rows(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The `keyed` rows that are their sets' first; empty sets are left out. No set is shuffled, unless there are very many copies."""
    ids = copies.select("id")
    return rows.where("n > 0").join(F.broadcast(ids) if ids.count() <= COPIES else ids, "id", "left_anti")


def token_sets(records: DataFrame) -> DataFrame:
    """`records` (id, block, tokens sorted and distinct) as distinct sets: id (the first's), block, key, n, tokens (hashes)."""
    rows = keyed(records)
    return first_rows(rows, copies_of(rows))


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of `token_sets` of one block whose Jaccard similarity is at least `least`. Ids are unique.

    Tiles of sets of like sizes meet, each pair of tiles in one task, which counts what the prefixes of two sets share and verifies the
    pairs that share enough; only similar pairs leave it, and a set is shuffled once. Tokens are compared by 64-bit hashes.
    """
    work = tiles.dealt(sets.select("block", F.col("id").cast("long").alias("id"), "n", "tokens"), least)
    return tiles.compared(work, tiles.similar(least), "a long, b long, similarity double")


def best_earlier(records: DataFrame, least: float) -> DataFrame:
    """(id, other, similarity): of the earlier rows of its block (id, block, tokens) that resemble a row by more than `least`, the most
    similar, the least id of equals. Pairs are between distinct sets; a copy takes its set's earliest row for 1."""
    rows = keyed(records.where(F.size("tokens") > 0))
    copied = copies_of(rows)
    pairs = cut(similar_sets(first_rows(rows, copied), least).where(F.col("similarity") > least))
    both = pairs.union(pairs.select("b", "a", "similarity"))
    first = rows.select("id").join(copied, "id", "left").select("id", F.coalesce("first", "id").alias("first"))
    copies = copied.select("id", F.col("first").alias("other"), F.lit(1.0).alias("similarity"))
    # a set's earliest row stands for it: an earlier row of another set exists if that set's earliest is earlier
    near = first.join(both.withColumnRenamed("a", "first"), "first").where("b < id").select("id", F.col("b").alias("other"), "similarity")
    best = copies.unionByName(near).groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("neg"))).alias("x"))
    return best.select("id", (-F.col("x.neg")).alias("other"), "x.similarity")


def best_overlap(items: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, similarity): the highest Jaccard similarity of each of `items` (id, block, tokens) with another row of `pool` (the same columns)
    in its block, however low; 0 where nothing is shared. A row that is in both does not count for itself."""
    rows = lambda df, asked: df.select("id", "block", "tokens", F.lit(asked).alias("asked"), F.lit(not asked).alias("stored"))
    return best_within(rows(items, True).unionByName(rows(pool, False)))


def best_within(records: DataFrame, least: float = 0.0) -> DataFrame:
    """`best_overlap` of the `asked` rows of `records` (id, block, tokens, asked, stored) with the `stored` ones; a row may be both, and
    two rows of one id, one of them asked, are one row that is both. A similarity below `least` counts as 0.

    Distinct sets are compared, not rows, by pairs of tiles, so a set is shuffled once and pairs never. A set whose rows all have a stored
    copy is not asked about. From a `least` on, only sets of sizes near asked ones meet, by prefixes; without one all of a block are
    compared, so the work grows with its square. Tokens are compared by 64-bit hashes.
    """
    rows = keyed(records, "asked", "stored")
    lone = rows.select("id", "block", "key", "asked", "stored", (F.col("n") > 0).alias("full"))
    # of a set's rows the one with the least id is compared for all, of two with that id the asked one
    kept = F.when(F.col("stored"), F.col("id"))
    each = lone.where("full").groupBy("block", "key").agg(F.min(F.struct("id", (~F.col("asked")).alias("late"))).alias("x"), F.min(kept).alias("low"), F.max(kept).alias("high"), F.bool_or("asked").alias("any"), F.count("*").alias("rows"))
    # with two stored ids in a set, each of its rows has another's
    sets = cut(each.select("block", "key", "x.id", "x.late", "low", "high", (F.col("any") & (F.col("low").isNull() | (F.col("low") == F.col("high")))).alias("any"), "rows"))
    firsts = sets.where("rows > 1").select("block", "key", F.col("id").alias("first"), "late", F.col("low").isNotNull().alias("has"), "any")
    members = lone.where("full").join(firsts, ["block", "key"])
    is_first = (F.col("id") == F.col("first")) & (F.col("asked") != F.col("late"))
    repeated = cut(members.select("id", F.col("asked").alias("own"), is_first.alias("stands"), "has", "any"))
    known = F.broadcast(repeated) if repeated.count() <= COPIES else repeated
    # a row that repeats none stands for itself
    met = rows.where("n > 0").join(known.withColumnRenamed("id", "known"), (F.col("id") == F.col("known")) & (F.col("asked") == F.col("own")), "left").where(F.coalesce("stands", F.lit(True)))
    met = met.select("block", "id", "n", "tokens", F.coalesce("any", "asked").alias("asked"), F.coalesce("has", "stored").alias("stored")).where("asked OR stored")
    if least > 0:
        wide = F.broadcast(met.where("asked").groupBy("block").agg(F.min("n").alias("from"), F.max("n").alias("to")))
        near = (F.col("n") >= F.col("from") * least - 1e-9) & (F.col("n") * least <= F.col("to") + 1e-9)
        work = tiles.dealt(met.join(wide, "block").where(near).select(*met.columns), least)
        found = tiles.compared(work, tiles.similar(least), "a long, b long, similarity double").withColumnRenamed("a", "id")
    else:
        found = tiles.compared(tiles.dealt(met, 0.0), tiles.best, "id long, similarity double")
    found = found.groupBy("id").agg(F.max("similarity").alias("similarity"))
    best = sets.select("block", "key", F.col("id").alias("first"), "low", "high").join(found.withColumnRenamed("id", "first"), "first", "left").drop("first")
    asked = lone.where("asked").select("id", "block", "key").join(best, ["block", "key"], "left")
    same = F.coalesce((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")), F.lit(False))
    return asked.select("id", F.when(same, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"))
