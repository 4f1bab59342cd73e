"""Windowed counts over event streams; an extension of ours, the same code for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if events.isStreaming else e


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of every window; on a stream, rows later than the watermark are left out."""
    e = _timed(events, late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of every session."""
    e = _timed(events, late)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
