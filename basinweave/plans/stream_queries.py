"""Queries that run as streams, with the SQL of their final results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.plans.content_queries import RATE_LIMIT
from basinweave.streaming import events


def x_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, counted by a stream."""
    out = events.run_to_table(events.window_counts(events.read_events(spark, d)), "windows")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def x_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by number of events, counted by a stream."""
    out = events.run_to_table(events.session_counts(events.read_events(spark, d)), "sessions")
    return out.groupBy("n").agg(F.count("*").alias("sessions"))


def x_stream_limit(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of each user that a limit of three an hour allows, decided by a stream that keeps state per user."""
    out = events.run_to_table(events.limit_rate(events.read_events(spark, d)), "limited", "append")
    return out.groupBy(F.col("user_id").cast("string").alias("key"), "allowed").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (x_stream_windows, x_stream_sessions, x_stream_limit)}

ORACLES = {
    "x_stream_limit": RATE_LIMIT,
    "x_stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "x_stream_sessions": "WITH a AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events), b AS (SELECT user_id, sum(CASE WHEN g IS NULL OR g >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a), c AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY 1, 2) SELECT n, count(*) AS sessions FROM c GROUP BY 1",
}
