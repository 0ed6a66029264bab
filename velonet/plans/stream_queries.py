"""Batch runs of the streaming aggregates, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from velonet.streaming import events as E

from . import adapters as D


def tumbling(spark, sf):
    return E.windowed(D.read(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 5).alias("mean"))


def session_counts(spark, sf):
    return E.sessions(D.read(spark, sf, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


QUERIES = {"st01_daily_windows": tumbling, "st02_sessions": session_counts}
ORACLES = {
    "st01_daily_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2",
    "st02_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
      SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""",
}
