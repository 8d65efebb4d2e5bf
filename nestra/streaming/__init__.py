"""Structured Streaming; an extension, as arrays themselves have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums and counts of event-time windows; state is dropped once the watermark has passed."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, every).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
