"""The registered query of `memlake.streaming.evidence`, beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.sources import views
from memlake.streaming import evidence

from .queries import E, query

_ID = "'ev_' || substr(sha256(CAST(session AS VARCHAR) || ':' || CAST(ordinal AS VARCHAR)), 1, 26)"
_ROWS = f"SELECT {_ID} AS evidence_id, session, role, sha256(coalesce(content, '')) AS content_hash, length(coalesce(content, '')) AS n_chars"


@query(f"""{E}, stored AS ({_ROWS} FROM evidence WHERE session % 3 = 0), batch AS ({_ROWS} FROM evidence UNION ALL {_ROWS} FROM (SELECT * REPLACE (content || '!' AS content) FROM evidence WHERE session % 5 = 0)),
 first AS (SELECT evidence_id, CASE WHEN session % 3 = 0 THEN 'stored' ELSE 'new' END AS origin FROM batch GROUP BY ALL)
SELECT evidence_id, origin, (SELECT count(*) FROM (SELECT DISTINCT b.content_hash FROM batch b WHERE b.evidence_id = f.evidence_id)) - 1 AS conflicts FROM first f""")
def evidence_persisted(spark, sf_dir):
    """A batch of all turns, a fifth of them also with a changed content, on a store that has a third of them."""
    turns = views.evidence(spark, sf_dir)
    stored = evidence.evidence_rows(turns.where("session % 3 = 0"), 100)
    changed = turns.where("session % 5 = 0").withColumn("content", F.concat("content", F.lit("!")))
    batch = evidence.evidence_rows(turns, 200).unionByName(evidence.evidence_rows(changed, 300))
    new, conflicts = evidence.merged(stored, batch)
    met = batch.select("evidence_id").distinct().join(new.select("evidence_id", F.lit("new").alias("origin")), "evidence_id", "left")
    counts = conflicts.groupBy("evidence_id").agg(F.count("*").alias("conflicts"))
    return met.join(counts, "evidence_id", "left").select("evidence_id", F.coalesce("origin", F.lit("stored")).alias("origin"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
