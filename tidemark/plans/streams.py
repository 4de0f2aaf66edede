"""Stream queries run to the end, against the same aggregation in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import coverage as C


def st_tumbling(spark, d):
    """Hourly coverage; complete mode keeps the windows that the watermark hasn't closed."""
    out = C.drained(C.tumbling(C.events(spark, d)), "st_tumbling", "complete")
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def st_distinct(spark, d):
    return C.drained(C.distinct(C.events(spark, d)), "st_distinct").groupBy("event_type").agg(F.count("*").alias("n"))


def st_sessions(spark, d):
    out = C.drained(C.sessions(C.events(spark, d)), "st_sessions", "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def st_running(spark, d):
    out = C.drained(C.running_counts(C.events(spark, d)), "st_running", "update", ["user_id"])
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (st_tumbling, st_distinct, st_sessions, st_running)}
ORACLES = {
    "st_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "st_distinct": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "st_sessions": "WITH s AS (SELECT user_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM s GROUP BY user_id",
    "st_running": "SELECT user_id, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total FROM events GROUP BY user_id",
}
