"""Queries of incremental work and event-time windows over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from townledger.plans.tables import table
from townledger.streaming import jobs


def incremental_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", "text", F.lit("chunk=2")), 256).alias("digest"))
    done = docs.filter("doc_id % 3 = 0").withColumn("digest", F.when(F.col("doc_id") % 2 == 0, F.col("digest")).otherwise(F.lit("old")))
    return jobs.pending(docs, done, ["doc_id"]).select("doc_id")


def enqueue_jobs(spark, d):
    e = table(spark, d, "events")
    queue = e.filter("event_type = 'click'").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 4).alias("stage"), F.when(F.col("event_id") % 2 == 0, "done").otherwise("running").alias("status"))
    new = e.filter("event_type = 'view'").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 4).alias("stage"))
    return jobs.enqueue(new, queue, ["stage", "document_id"])


def job_state_latest(spark, d):
    return jobs.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def budget_cutoff(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").cast("decimal(12,2)").alias("cost"))
    return jobs.budget_cutoff(e, "user_id", "event_id", "cost", 500).select("event_id", "allowed")


def events_tumbling(spark, d):
    return jobs.tumbling(table(spark, d, "events"), "ts", "6 hours", "event_type").select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def events_session(spark, d):
    return jobs.sessions(table(spark, d, "events"), "ts", "2 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (incremental_skip, enqueue_jobs, job_state_latest, budget_cutoff, events_tumbling, events_session)}
ORACLES = {
    "incremental_skip": "SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)",
    "enqueue_jobs": "SELECT DISTINCT event_id % 4 AS stage, user_id AS document_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.event_id % 2 != 0 AND c.user_id = v.user_id AND c.event_id % 4 = v.event_id % 4)",
    "job_state_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "budget_cutoff": "SELECT event_id, sum(value::DECIMAL(12,2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 500 AS allowed FROM events",
    "events_tumbling": "SELECT epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "events_session": "WITH e AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOURS, FALSE)::INT AS g FROM events), s AS (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}
