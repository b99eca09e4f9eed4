"""Windowed counts over event streams; the batch engine needs no streams, so this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, minutes: int = 60, late_minutes: int = 10) -> DataFrame:
    """Events by window and type; works alike on a stream, where the watermark bounds the state, and on a table."""
    marked = events.withWatermark("ts", f"{late_minutes} minutes") if events.isStreaming else events
    return marked.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
