"""Counting in time windows, on a batch or a stream alike (ours: the analogue in time of
counting in bins). Late rows are dropped by a watermark on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_counts(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, value in tumbling windows, or sliding ones with `slide`."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        x = x.withWatermark("ts", late)
    x = x.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")
