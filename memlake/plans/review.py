"""The registered queries of `memlake.operators.review`, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import review
from memlake.sources import views
from memlake.sources.views import AS_OF

from .queries import M, query
from .upkeep import derived, sql_view

_DUE = AS_OF - 20 * 86400
#: Items of the review store, alike in Spark and in SQL: a third of all waiting ones have one content.
ITEM = {
    "id": "concat('rev_', lpad(CAST(store_ordinal AS STRING), 6, '0'))",
    "content_key": "CASE WHEN store_ordinal % 3 = 0 THEN 'same' ELSE concat(type, CAST(store_ordinal % 60 AS STRING)) END",
    "item_status": "CASE WHEN store_ordinal % 7 = 0 THEN 'ACCEPTED' WHEN store_ordinal % 11 = 0 THEN 'REJECTED' ELSE 'PENDING' END",
    "expires_s": "at_s + 7 * 86400 + CASE WHEN store_ordinal % 2 = 0 THEN 30 * 86400 ELSE 0 END",
}
_SQL = f"""{M}, {sql_view('raw', ITEM, 'memories')}, now AS (SELECT id, project_id, content_key, type, confidence, at_s AS created_s, store_ordinal, CASE WHEN item_status = 'PENDING' AND expires_s <= {_DUE} THEN 'EXPIRED' ELSE item_status END AS status FROM raw),
 waiting AS (SELECT *, first_value(id) OVER (PARTITION BY project_id, content_key ORDER BY confidence DESC, created_s, id) AS primary_id FROM now WHERE status = 'PENDING')"""


def _items(spark, sf_dir):
    raw = derived(views.memories(spark, sf_dir), ITEM)
    return raw.select("id", "project_id", "content_key", "type", "confidence", F.col("at_s").alias("created_s"), "expires_s", F.col("item_status").alias("status"), "store_ordinal")


@query(f"""{_SQL}, said AS (SELECT w.project_id, w.content_key, arg_min(CASE WHEN store_ordinal % 5 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END, store_ordinal) AS verdict, min(store_ordinal) AS at FROM waiting w WHERE store_ordinal % 5 < 2 GROUP BY ALL)
SELECT n.id, coalesce(CASE WHEN w.id IS NOT NULL THEN s.verdict END, n.status) AS status, CASE WHEN w.id IS NOT NULL AND s.verdict IS NOT NULL AND w.primary_id <> n.id THEN w.primary_id ELSE '' END AS duplicate_of,
 CASE WHEN w.primary_id = n.id AND s.verdict IS NOT NULL THEN 'note ' || CAST(s.at AS VARCHAR) ELSE '' END AS note FROM now n LEFT JOIN waiting w USING (id) LEFT JOIN said s ON s.project_id = n.project_id AND s.content_key = n.content_key""".replace("AS at FROM", "AS first_at FROM").replace("s.at AS", "s.first_at AS"))
def review_decided(spark, sf_dir):
    items = _items(spark, sf_dir)
    said = items.where("store_ordinal % 5 < 2").select(F.col("store_ordinal").alias("ordinal"), "id", F.when(F.col("store_ordinal") % 5 == 0, "ACCEPTED").otherwise("REJECTED").alias("status"), F.concat(F.lit("note "), F.col("store_ordinal").cast("string")).alias("note"))
    return review.decided(items, said, _DUE)


@query(f"""{_SQL}, hit AS (SELECT id FROM waiting WHERE id = primary_id AND type = 'lesson')
SELECT n.id, CASE WHEN h.id IS NOT NULL THEN 'REJECTED' ELSE n.status END AS status, CASE WHEN h.id IS NOT NULL AND n.id <> h.id THEN h.id ELSE '' END AS duplicate_of, CASE WHEN n.id = h.id THEN 'no lessons' ELSE '' END AS note FROM now n LEFT JOIN waiting w USING (id) LEFT JOIN hit h ON h.id = w.primary_id""")
def review_reject_matching(spark, sf_dir):
    return review.rejected_matching(_items(spark, sf_dir), F.col("type") == "lesson", "no lessons", _DUE)


_NAME = "'rev_' || substr(sha256(candidate_id || '/' || project_id), 1, 26)"


@query(f"""{M}, stored AS (SELECT {_NAME} AS id, project_id, event_key FROM (SELECT 'c' || CAST(store_ordinal % 300 AS VARCHAR) AS candidate_id, project_id, type || CAST(store_ordinal % 90 AS VARCHAR) AS event_key FROM memories WHERE store_ordinal % 4 = 0)),
 asked AS (SELECT store_ordinal AS ordinal, 'c' || CAST(store_ordinal % 450 AS VARCHAR) AS candidate_id, project_id, type || CAST(store_ordinal % 140 AS VARCHAR) AS event_key, store_ordinal % 13 = 0 AS rejected FROM memories),
 named AS (SELECT *, {_NAME} AS own_id FROM asked), met AS (SELECT n.*, (SELECT min(id) FROM stored s WHERE s.project_id = n.project_id AND s.event_key = n.event_key) AS stored_id, n.own_id IN (SELECT id FROM stored) AS taken FROM named n),
 open AS (SELECT *, row_number() OVER (PARTITION BY project_id, event_key ORDER BY ordinal) AS place, first_value(own_id) OVER (PARTITION BY project_id, event_key ORDER BY ordinal) AS first_id FROM met WHERE NOT rejected AND stored_id IS NULL AND NOT taken),
 firsts AS (SELECT ordinal, row_number() OVER (PARTITION BY own_id ORDER BY ordinal) AS turn FROM open WHERE place = 1)
SELECT m.candidate_id, m.project_id, CASE WHEN m.rejected THEN 'REJECTED' WHEN m.stored_id IS NOT NULL THEN 'EXISTING' WHEN m.taken THEN 'REFUSED' WHEN f.turn = 1 THEN 'ADDED' WHEN f.turn > 1 THEN 'REFUSED' ELSE 'EXISTING' END AS outcome,
 CASE WHEN m.rejected THEN NULL WHEN m.stored_id IS NOT NULL THEN m.stored_id WHEN m.taken THEN NULL WHEN f.turn = 1 THEN m.own_id WHEN f.turn > 1 THEN NULL ELSE o.first_id END AS id FROM met m LEFT JOIN open o USING (ordinal) LEFT JOIN firsts f USING (ordinal)""")
def review_added(spark, sf_dir):
    m = views.memories(spark, sf_dir)
    n, text = F.col("store_ordinal"), lambda x: x.cast("string")
    asked = m.select(n.alias("ordinal"), F.concat(F.lit("c"), text(n % 450)).alias("candidate_id"), "project_id", F.concat("type", text(n % 140)).alias("event_key"))
    before = m.where("store_ordinal % 4 = 0").select(F.concat(F.lit("c"), text(n % 300)).alias("candidate_id"), "project_id", F.concat("type", text(n % 90)).alias("event_key"))
    name = F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("/", "candidate_id", "project_id"), 256), 1, 26))
    return review.added(before.select(name.alias("id"), "project_id", "event_key"), asked, F.col("ordinal") % 13 == 0)
