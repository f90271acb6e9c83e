"""The registered queries of `memlake.operators.jobs`, each beside its DuckDB SQL: a job's events one after the other, by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import jobs
from memlake.sources import views

from .queries import query
from .upkeep import derived, sql_view

#: 2024-01-20 00:00:00 UTC
AS_OF = 1705708800
#: Ledger rows as events of the job machine; the jobs' times are pressed together so that some leases hold and some run out.
EVENT = {
    "job_action": "CASE WHEN ordinal % 11 = 0 THEN 'REQUEUED' WHEN ordinal % 13 = 0 THEN 'RENEWED' WHEN ordinal % 29 = 0 THEN 'TERMINAL' WHEN action = 'DEAD_LETTER' THEN 'FAILED' WHEN ordinal < 3000 THEN 'ENQUEUED' ELSE action END",
    "job_at": "1704067200 + ordinal * 300 + CASE WHEN ordinal % 3 = 0 THEN ordinal % 4000 ELSE 0 - 297 * ordinal + CAST(floor(ordinal / 997) AS BIGINT) * 200 END",
}
_EVENTS = f"{views.with_views('ledger')}, {sql_view('timed', EVENT, 'ledger')}, events_of AS (SELECT job, ordinal, job_action AS action, job_at AS at_s FROM timed)"
_RUN = """numbered AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY at_s, ordinal) AS nr FROM %s),
 run(job, nr, ordinal, action, at_s, status, attempt, since, accepted, expired) AS (
  SELECT DISTINCT job, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, '', 0::BIGINT, 0::BIGINT, false, false FROM numbered
  UNION ALL SELECT job, nr, ordinal, action, at_s, CASE WHEN ok THEN following ELSE now END, CASE WHEN NOT ok THEN attempt WHEN action = 'CLAIMED' THEN attempt + 1 WHEN action IN ('ENQUEUED', 'REQUEUED') THEN 0 ELSE attempt END,
   CASE WHEN ok AND action IN ('CLAIMED', 'RENEWED') THEN at_s WHEN ok AND action = 'ENQUEUED' THEN 0 ELSE since END, ok, now <> status FROM (
   SELECT *, following IS NOT NULL AS ok FROM (
    SELECT *, CASE action WHEN 'ENQUEUED' THEN CASE WHEN now = '' THEN 'QUEUED' END WHEN 'CLAIMED' THEN CASE WHEN now = 'QUEUED' THEN 'CLAIMED' END WHEN 'REQUEUED' THEN CASE WHEN now = 'DEAD_LETTER' THEN 'QUEUED' END
      WHEN 'PROCESSING' THEN CASE WHEN now = 'CLAIMED' THEN 'PROCESSING' END ELSE CASE WHEN now IN ('CLAIMED', 'PROCESSING') THEN CASE action WHEN 'RENEWED' THEN now WHEN 'COMMITTED' THEN 'COMMITTED' WHEN 'TERMINAL' THEN 'DEAD_LETTER' WHEN 'FAILED' THEN CASE WHEN attempt >= 3 THEN 'DEAD_LETTER' ELSE 'QUEUED' END END END END AS following FROM (
     SELECT n.job, n.nr, n.ordinal, n.action, n.at_s, r.status, r.attempt, r.since, CASE WHEN r.status IN ('CLAIMED', 'PROCESSING') AND n.at_s >= r.since + 300 THEN CASE WHEN r.attempt >= 3 THEN 'DEAD_LETTER' ELSE 'QUEUED' END ELSE r.status END AS now
     FROM run r JOIN numbered n ON n.job = r.job AND n.nr = r.nr + 1))))"""


def _events(spark, sf_dir):
    return derived(views.ledger(spark, sf_dir), EVENT).select("job", "ordinal", F.col("job_action").alias("action"), F.col("job_at").alias("at_s"))


@query(f"{_EVENTS}, {_RUN % 'events_of'} SELECT job, ordinal, action, at_s, accepted, expired, status, attempt FROM run WHERE nr > 0")
def job_history(spark, sf_dir):
    return jobs.job_history(_events(spark, sf_dir))


@query(f"""{_EVENTS}, early AS (FROM events_of WHERE at_s <= {AS_OF}), {_RUN % 'early'}, last AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY job ORDER BY nr DESC) = 1)
SELECT job, CASE WHEN held AND attempt >= 3 THEN 'DEAD_LETTER' WHEN held THEN 'QUEUED' ELSE status END AS status, attempt, held AS recovered FROM (SELECT *, status IN ('CLAIMED', 'PROCESSING') AND {AS_OF} >= since + 300 AS held FROM last)""")
def job_states(spark, sf_dir):
    return jobs.job_states(_events(spark, sf_dir), AS_OF)
