"""The registered queries of `memlake.operators.audit`, each beside its DuckDB SQL: all pairs at once, and retiring pair after pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import audit
from memlake.operators.upkeep import STATUS_NOTE
from memlake.sources import views
from memlake.sources.views import AS_OF, table

from .queries import QUESTIONS, S, _holds, query, quoted, rlike

_AUDITED = [(q, g) for q, g in QUESTIONS if q != "orchestration"]
#: Vectors of four records each: one, a mixture near it, its copy, and a mixture farther off.
_VECTORS = """mixed AS (SELECT e.vec_id AS id, CASE e.vec_id % 4 WHEN 1 THEN list_transform(list_zip(b.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * 0.9 + CAST(p[2] AS DOUBLE) * 0.1) WHEN 3 THEN list_transform(list_zip(b.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * 0.68 + CAST(p[2] AS DOUBLE) * 0.32)
  ELSE list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id - e.vec_id % 4)"""
_PAIRED = f"""{S}, {_VECTORS}, live AS (SELECT store_ordinal AS id, memory_id, CASE WHEN store_ordinal % 5 = 0 THEN '' ELSE 'p' || CAST(store_ordinal // 40 AS VARCHAR) END AS project, type, content, at_s, store_ordinal % 3 AS used, store_ordinal % 2 AS delivered FROM statements WHERE status = 'active'),
 held AS (SELECT l.id, l.project, m.v, min(l.id) OVER (PARTITION BY l.project, m.v) AS first FROM live l JOIN mixed m USING (id)),
 pairs AS (SELECT * FROM (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 9) AS similarity FROM held x JOIN held y ON x.project = y.project AND x.id < y.id AND x.id = x.first AND y.id = y.first) WHERE similarity >= 0.85
  UNION ALL SELECT first, id, 1e0 FROM held WHERE id <> first)"""


def _live(spark, sf_dir):
    n = F.col("store_ordinal")
    s = views.statements(spark, sf_dir).where("status = 'active'")
    project = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("p"), F.floor(n / 40).cast("string")))
    return s.select(n.alias("id"), "memory_id", project.alias("project_id"), "type", "content", "at_s", (n % 3).alias("used"), (n % 2).alias("delivered"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    base = e.select(F.col("id").alias("base"), F.col("embedding").alias("own"))
    mixed = lambda w: F.zip_with("own", "embedding", lambda x, y: x.cast("double") * w + y.cast("double") * round(1 - w, 2))
    at = F.col("id") % 4
    return e.join(base, F.col("base") == F.col("id") - at).select("id", F.when(at == 1, mixed(0.9)).when(at == 3, mixed(0.68)).otherwise(F.transform("own", lambda x: x.cast("double"))).alias("embedding"))


@query(f"{_PAIRED} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def cosine_pairs(spark, sf_dir):
    blocks = _live(spark, sf_dir).select("id", F.col("project_id").alias("block"))
    return audit.cosine_pairs(_vectors(spark, sf_dir).join(blocks, "id"), audit.NEAR, 64).withColumn("similarity", F.round("similarity", 6))


_CARRIERS = " UNION ALL ".join(f"SELECT {quoted(q)} AS question, project, id FROM live WHERE {_holds(g)}" for q, g in _AUDITED)
_NOT = "len(list_filter(c.ids, lambda i: NOT list_contains(r.gone, i))) = 1"


@query(f"""{_PAIRED}, carriers AS (SELECT question, project, list(id) AS ids FROM ({_CARRIERS}) GROUP BY ALL), ranks AS (SELECT id, row(used, delivered, at_s, length(content)) AS standing FROM live),
 ordered AS (SELECT p.*, CASE WHEN x.standing >= y.standing THEN b ELSE a END AS d, CASE WHEN x.standing >= y.standing THEN a ELSE b END AS k, row_number() OVER (ORDER BY similarity DESC, a, b) AS nr FROM pairs p JOIN ranks x ON x.id = p.a JOIN ranks y ON y.id = p.b WHERE similarity >= 0.95),
 run(nr, gone, kind, d, k, similarity) AS (SELECT 0::BIGINT, []::BIGINT[], '', 0::BIGINT, 0::BIGINT, 0::DOUBLE UNION ALL SELECT nr, CASE WHEN kind = 'RETIRED' THEN list_append(gone, d2) ELSE gone END, kind, d2, k2, similarity FROM (
  SELECT o.nr, r.gone, o.similarity, CASE WHEN list_contains(r.gone, o.a) OR list_contains(r.gone, o.b) THEN 'VOID' WHEN gd AND gk THEN 'DUPLICATE_PROTECTED' ELSE 'RETIRED' END AS kind, CASE WHEN gd THEN o.k ELSE o.d END AS d2, CASE WHEN gd THEN o.d ELSE o.k END AS k2
  FROM (SELECT r.gone, r.nr, o.nr AS onr, EXISTS (FROM carriers c WHERE list_contains(c.ids, o.d) AND {_NOT}) AS gd, EXISTS (FROM carriers c WHERE list_contains(c.ids, o.k) AND {_NOT}) AS gk FROM run r JOIN ordered o ON o.nr = r.nr + 1) r JOIN ordered o ON o.nr = r.onr)),
 gone AS (SELECT d AS id FROM run WHERE kind = 'RETIRED'),
 near AS (SELECT CASE WHEN x.standing >= y.standing THEN b ELSE a END AS d, CASE WHEN x.standing >= y.standing THEN a ELSE b END AS k, similarity FROM pairs p JOIN ranks x ON x.id = p.a JOIN ranks y ON y.id = p.b WHERE similarity < 0.95 AND a NOT IN (FROM gone) AND b NOT IN (FROM gone))
SELECT kind, x.memory_id, y.memory_id AS other_id, round(similarity, 3) AS similarity FROM (SELECT kind, d, k, similarity FROM run WHERE kind IN ('RETIRED', 'DUPLICATE_PROTECTED') UNION ALL SELECT 'NEAR_DUPLICATE', d, k, similarity FROM near) JOIN live x ON x.id = d JOIN live y ON y.id = k
UNION ALL SELECT 'STALE_STATUS_NOTE', memory_id, '', 0e0 FROM live WHERE id NOT IN (FROM gone) AND type = 'observation' AND ({AS_OF} - at_s) / 86400e0 >= 14 AND {rlike('lower(content)', STATUS_NOTE)}
UNION ALL SELECT 'NEVER_DELIVERED', memory_id, '', 0e0 FROM live WHERE id NOT IN (FROM gone) AND ({AS_OF} - at_s) / 86400e0 >= 28 AND delivered = 0 AND NOT EXISTS (FROM carriers c WHERE len(c.ids) = 1 AND c.ids[1] = live.id)""")
def memory_audit(spark, sf_dir):
    low = F.lower("content")

    def holds(groups):
        every = F.lit(True)
        for group in groups:
            one = F.lit(False)
            for term in group:
                one = one | low.contains(term)
            every = every & one
        return every

    return audit.audit(_live(spark, sf_dir), _vectors(spark, sf_dir), {q: holds(g) for q, g in _AUDITED}, low.rlike(STATUS_NOTE), AS_OF)
