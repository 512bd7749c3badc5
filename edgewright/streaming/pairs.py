"""Audit of pairs as they arrive, by Structured Streaming on events (event_id, ts, user_id, event_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark; its time has to be a timestamp with a zone. A table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, users): events of a tumbling window, taken up to ``late`` after."""
    events = _timed(events, late)
    users = F.approx_count_distinct("user_id").alias("users")
    counted = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), users)
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n) of runs of a user's events no further apart than ``gap``."""
    events = _timed(events, late)
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without those that repeat an id; a stream forgets ids after ``late``."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
