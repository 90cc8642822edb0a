"""Queries over job events and job state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.streaming import jobs as J

from . import derived as D
from .registry import query

WITH = "WITH RECURSIVE "
#: The state machine again, as one recursive walk along each job's events.
FOLD = f"""{D.JOBS}, e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, ord) AS r FROM jobs),
 f AS (SELECT job_id, r, 'Queued' AS status, 0 AS progress, 'Queued' AS stage, false AS cancel, ts AS created_at FROM e WHERE r = 1 UNION ALL
  SELECT f.job_id, e.r,
   CASE WHEN f.status IN ('Done', 'Failed', 'Cancelled') THEN f.status WHEN e.kind = 'cancel' AND f.status = 'Queued' THEN 'Cancelled' WHEN e.kind = 'start' AND f.status = 'Queued' THEN 'Running'
        WHEN f.status = 'Running' AND e.kind = 'finish' THEN 'Done' WHEN f.status = 'Running' AND e.kind IN ('progress', 'fail') AND f.cancel THEN 'Cancelled' WHEN f.status = 'Running' AND e.kind = 'fail' THEN 'Failed' ELSE f.status END,
   CASE WHEN f.status = 'Running' AND e.kind = 'finish' THEN 100 WHEN f.status = 'Running' AND e.kind = 'progress' AND NOT f.cancel THEN greatest(f.progress, least(e.percent, 99)) ELSE f.progress END,
   CASE WHEN f.status = 'Queued' AND e.kind = 'start' THEN 'Starting' WHEN f.status = 'Running' AND e.kind = 'finish' THEN 'Done' WHEN f.status = 'Running' AND e.kind = 'cancel' THEN 'Cancelling' WHEN f.status = 'Running' AND e.kind = 'progress' AND NOT f.cancel THEN e.stage ELSE f.stage END,
   f.cancel OR (e.kind = 'cancel' AND f.status IN ('Queued', 'Running')), f.created_at
  FROM f JOIN e ON e.job_id = f.job_id AND e.r = f.r + 1),
 final AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY r DESC) = 1)"""


@query(f"{WITH}{FOLD} SELECT job_id, status, progress, stage FROM final")
def job_final_state(spark: SparkSession, sf: str) -> DataFrame:
    return J.final_state(D.job_events(spark, sf)).select("job_id", "status", "progress", "stage")


@query(f"{WITH}{FOLD} SELECT f.job_id, e.ord, f.progress FROM f JOIN e ON e.job_id = f.job_id AND e.r = f.r JOIN f g ON g.job_id = f.job_id AND g.r = f.r - 1 WHERE e.kind = 'progress' AND g.status = 'Running' AND NOT g.cancel")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    return J.progress(D.job_events(spark, sf)).select("job_id", "ord", "progress")


@query(f"{WITH}{FOLD} SELECT count(*) FILTER (status = 'Running') AS running, count(*) FILTER (status = 'Queued') AS queued FROM final")
def job_counts(spark: SparkSession, sf: str) -> DataFrame:
    return J.counts(J.final_state(D.job_events(spark, sf)))


@query(f"{WITH}{FOLD} SELECT job_id, CASE WHEN status IN ('Queued', 'Running') THEN 'Failed' ELSE status END AS status FROM final")
def job_recover(spark: SparkSession, sf: str) -> DataFrame:
    return J.recover(J.final_state(D.job_events(spark, sf))).select("job_id", "status")


@query("SELECT user_id::VARCHAR AS job_id, arg_min(event_type, (ts, event_id)) AS input_path, arg_min(event_id, (ts, event_id)) AS ord FROM events GROUP BY user_id")
def job_dedup(spark: SparkSession, sf: str) -> DataFrame:
    s = D.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("input_path"))
    return J.dedup(s).select("job_id", "input_path", "ord")


@query("SELECT user_id::VARCHAR AS job_id, count(DISTINCT event_type) AS files FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def job_clashes(spark: SparkSession, sf: str) -> DataFrame:
    return J.clashes(D.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("input_path")))


@query(f"{WITH}{FOLD} SELECT job_id, status, created_at FROM final WHERE status = 'Done' ORDER BY created_at DESC, job_id")
def jobs_recent(spark: SparkSession, sf: str) -> DataFrame:
    return J.recent(J.final_state(D.job_events(spark, sf)), J.DONE).select("job_id", "status", "created_at")


LIVE = f"{FOLD}, queue AS (SELECT job_id, CASE WHEN ascii(right(job_id, 1)) % 3 = 0 THEN 'Queued' ELSE status END AS status, created_at FROM final)"


@query(f"{WITH}{LIVE}, n AS (SELECT count(*) FILTER (status = 'Running') AS n FROM queue), q AS (SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS place FROM queue WHERE status = 'Queued') SELECT job_id FROM q, n WHERE place + n <= 4000")
def job_limit(spark: SparkSession, sf: str) -> DataFrame:
    jobs = J.final_state(D.job_events(spark, sf)).withColumn("status", F.when(F.ascii(F.right("job_id", F.lit(1))) % 3 == 0, "Queued").otherwise(F.col("status")))
    return J.admit(jobs, 4000).select("job_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 6 + floor(54 * least(1.0, (event_id % 40) / 40.0)) WHEN 'view' THEN 65 + floor(17 * least(1.0, (event_id % 40) / 40.0)) END::INT AS percent FROM events")
def stage_bands(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", "Translating").when(F.col("event_type") == "view", "Verifying")
    return D.table(spark, sf, "events").select("event_id", J.stage_percent(stage, F.col("event_id") % 40, F.lit(40)).alias("percent"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'status=' || event_type ELSE 'stage=s' || (event_id % 5) || ';status=' || event_type END AS kept FROM events")
def known_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    raw = F.create_map(F.lit("stage"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string"))).otherwise(""), F.lit("odd"), F.lit("x"), F.lit("status"), F.col("event_type"))
    kept = F.array_sort(F.map_entries(J.known_fields(raw, ("status", "stage"))))
    return e.select("event_id", F.array_join(F.transform(kept, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("kept"))


@query(f"{WITH}{FOLD} SELECT job_id, status, progress, created_at FROM final WHERE job_id = (SELECT min(job_id) FROM final)")
def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    jobs = J.final_state(D.job_events(spark, sf))
    first = D.job_events(spark, sf).agg(F.min("job_id")).first()[0]
    return J.lookup(jobs, first).select("job_id", "status", "progress", "created_at")


@query(f"{WITH}{FOLD} SELECT job_id AS \"jobId\", status, progress, stage, created_at AS \"createdAt\" FROM final")
def job_status_view(spark: SparkSession, sf: str) -> DataFrame:
    return J.status_view(J.final_state(D.job_events(spark, sf)).select("job_id", "status", "progress", "stage", "created_at"))
