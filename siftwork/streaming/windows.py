"""Event-time windows that work on streams and, for comparison, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events with ts as a UTC timestamp and a watermark; watermarks don't take timestamps without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event_type: tumbling windows, or sliding ones with slide."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = timed(events).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a pause of gap."""
    out = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key while the watermark remembers it."""
    return timed(events).dropDuplicatesWithinWatermark(keys)
