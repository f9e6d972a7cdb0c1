"""Event-time windows, the same function for batches and streams. Beyond the batch operators' parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each user and type in windows of a length; on streams late rows are dropped after the watermark."""
    events = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("at", late)
    out = events.groupBy(F.window("at", length).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
