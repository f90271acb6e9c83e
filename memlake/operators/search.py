"""Retrieval: scope filter, lexical, semantic and hybrid search, heuristic ranking. Each is one lazy plan that ends in a top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring
from memlake.functions.text import jaccard, words

GATE, SHORTLIST = 0.05, 10
#: Vectors that meet a block of queries at a time.
SLICE = 512


def in_scope(project_id: str | None, scope: str = "default") -> Column:
    """default: global records and the project's own; global; project (needs the id); all."""
    if scope == "project" and not project_id:
        raise ValueError("the scope project needs a project_id")
    shared, own = F.col("scope") == "global", (F.col("scope") == "project") & (F.col("project_id") == (project_id or ""))
    return {"default": shared | own, "global": shared, "project": own, "all": F.lit(True)}[scope]


def active() -> Column:
    """A missing status means active."""
    return F.coalesce(F.col("status"), F.lit("active")) == "active"


def lexical_search(records: DataFrame, query: str, as_of: int, k: int = 5, project_id: str | None = None, scope: str = "default") -> DataFrame:
    """memory_id, store_ordinal, type, content (100 characters), similarity, score: active records in scope that share words with `query`."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    seen = records.where(in_scope(project_id, scope) & active()).withColumn("similarity", jaccard(asked, words(F.col("content")))).where(F.col("similarity") >= GATE)
    score = scoring.lexical(F.col("similarity"), F.col("quality_score"), F.col("type"), F.col("at_s"), as_of)
    return seen.select("memory_id", "store_ordinal", "type", F.substring("content", 1, 100).alias("content"), "similarity", score.alias("score")).orderBy(F.desc("score"), "store_ordinal").limit(k)


def by_type(records: DataFrame, kind: str, as_of: int, k: int = 10) -> DataFrame:
    """The best records of a type by quality and freshness, whatever their status."""
    score = F.col("quality_score") * 0.6 + scoring.freshness(F.col("at_s"), as_of) * 0.4
    return records.where(F.col("type") == kind).select("memory_id", "store_ordinal", score.alias("score")).orderBy(F.desc("score"), "store_ordinal").limit(k)


def semantic_search(records: DataFrame, vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """memory_id, store_ordinal, similarity: the records with the nearest vectors (`vectors`: vec_id, embedding), whatever their status."""
    near = vectors.select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.lit(np.array(query, dtype=np.float64))), 9).alias("similarity"))
    return records.join(near, F.col("store_ordinal") == F.col("vec_id")).select("memory_id", "store_ordinal", "similarity").orderBy(F.desc("similarity"), "store_ordinal").limit(k)


def batch_semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest of all `vectors` for each of `queries` (both vec_id, embedding).

    Queries are taken in blocks of `block`, which is what a task holds; each task leaves its own k best per query, so the shuffle carries
    k rows a task and query, and never all pairs; a task holds the products of a block with `SLICE` vectors at a time.
    """
    ids = [r[0] for r in queries.select("vec_id").distinct().orderBy("vec_id").collect()]  # the caller's query set
    out = None
    for lo in range(0, max(1, len(ids)), block):
        own = queries.where(F.col("vec_id").isin(ids[lo : lo + block])).orderBy("vec_id").toPandas()
        matrix = np.array(own["embedding"].tolist(), np.float64).reshape(len(own), -1)
        names = own["vec_id"].to_numpy(np.int64)
        found = vectors.select("vec_id", "embedding").mapInPandas(_nearest(names, matrix, k), "query_id long, vec_id long, similarity double")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(names: np.ndarray, matrix: np.ndarray, k: int):
    norms = np.linalg.norm(matrix, axis=1)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the k best of what a task has seen so far, by query; a slice of vectors at a time meets them
        best, found = np.empty((len(names), 0)), np.empty((len(names), 0), np.int64)
        for frame in frames:
            for lo in range(0, len(frame) if len(names) else 0, SLICE):
                x = frame.iloc[lo : lo + SLICE]
                own = np.array(x["embedding"].tolist(), np.float64)
                ids = x["vec_id"].to_numpy(np.int64)
                length = norms[:, None] * np.linalg.norm(own, axis=1)
                near = np.round(np.divide(matrix @ own.T, length, out=np.zeros(length.shape), where=length > 0), 9)
                near, all_ids = np.hstack([best, near]), np.hstack([found, np.broadcast_to(ids, near.shape)])
                order = np.lexsort((all_ids, -near), axis=1)[:, :k]
                best, found = np.take_along_axis(near, order, 1), np.take_along_axis(all_ids, order, 1)
        if best.size:
            yield pd.DataFrame({"query_id": np.repeat(names, best.shape[1]), "vec_id": found.ravel(), "similarity": best.ravel()})

    return scan


def hybrid(lexical: DataFrame, semantic: DataFrame, records: DataFrame, k: int = 10) -> DataFrame:
    """Both result lists, joined by memory_id: scores, search_type and the combined score with the records' novelty.

    Without semantic rows the lexical score counts whole. The lists are shortlists of bounded length, so they are broadcast to the records.
    """
    sem = semantic.select("memory_id", F.col("similarity").alias("semantic_score"), F.lit(1).alias("s"))
    lex = lexical.select("memory_id", F.col("score").alias("lexical_score"), F.lit(1).alias("l"))
    both = lex.join(sem, "memory_id", "full")
    weighted = both.withColumn("any_semantic", F.max("s").over(Window.partitionBy()).isNotNull())  # two shortlists
    kind = F.when(F.col("l").isNull(), "semantic").when(F.col("s").isNull(), "lexical").otherwise("both")
    lexical_score, semantic_score = F.coalesce("lexical_score", F.lit(0.0)), F.coalesce("semantic_score", F.lit(0.0))
    base = weighted.select("memory_id", kind.alias("search_type"), lexical_score.alias("lexical_score"), semantic_score.alias("semantic_score"), F.when(F.col("any_semantic"), lexical_score * 0.4 + semantic_score * 0.6).otherwise(lexical_score).alias("base"), F.coalesce(F.col("l"), F.lit(0)).alias("lexical_first"))
    known = records.join(F.broadcast(base), "memory_id", "right")
    combined = F.col("base") * F.when(F.col("store_ordinal").isNull(), 1.0).otherwise(1.0 + F.col("novelty") * 0.1)
    columns = ["memory_id", "store_ordinal", "content", "quality_score", "novelty", "at_s", "search_type", "lexical_score", "semantic_score", "lexical_first"]
    return known.select(*columns, combined.alias("combined_score")).orderBy(F.desc("combined_score"), F.desc("lexical_first"), "store_ordinal").limit(k)


def heuristic_rank(found: DataFrame, query: str, as_of: int, weights: dict[str, float] | None = None) -> DataFrame:
    """`found` (`hybrid`) with five features and their weighted sum ml_score, best first."""
    features = {
        "search_relevance": F.col("combined_score"), "memory_quality": F.coalesce("quality_score", F.lit(0.5)), "recency": scoring.recency(F.col("at_s"), as_of),
        "novelty": F.coalesce("novelty", F.lit(0.5)), "match_type": scoring.match_type(query, F.col("content")),
    }
    return found.select("memory_id", "store_ordinal", *[v.alias(f"f_{k}") for k, v in features.items()], scoring.weighted(features, weights).alias("ml_score")).orderBy(F.desc("ml_score"), "store_ordinal")
