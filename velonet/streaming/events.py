"""Streaming counterparts of the aggregates: the same functions run over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.functions import arrays as A

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(start, event_type, n, mean): counts and finite means by window; state is dropped ``late`` behind the newest event."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    v = A.finite(F.col("value"))
    got = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, n): runs of a user's events with pauses under ``gap``."""
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("s.start").alias("start"), "n")
