"""Streaming queries: the events table read as a stream, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.events import TOKEN_BUCKET_SQL
from lectern.plans.registry import Tables, query
from lectern.sources.files import event_stream
from lectern.streaming import events as E


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def stream_hourly_counts(t: Tables) -> DataFrame:
    counts = E.windowed(event_stream(t.spark, t.folder), "1 hour", ["event_type"])
    out = E.run_available(counts, "hourly", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k
""")
def stream_session_counts(t: Tables) -> DataFrame:
    counts = E.session_counts(event_stream(t.spark, t.folder), "6 hours", "user_id")
    out = E.run_available(counts, "sessions", "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND value >= 50")
def stream_alerts(t: Tables) -> DataFrame:
    return E.run_available(E.alerts(event_stream(t.spark, t.folder), ["error", "signup"], 50.0).select("event_id", "user_id", "event_type"), "alerts")


@query(TOKEN_BUCKET_SQL)
def stream_token_bucket(t: Tables) -> DataFrame:
    return E.run_available(E.token_bucket(event_stream(t.spark, t.folder), "user_id", 3, 86400), "bucket")
