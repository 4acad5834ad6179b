"""Streaming extension: running scores of event streams with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean and count of ``value`` by event type and tumbling window of ``ts``; rows later than ``late`` are left out.

    ``events`` may be a stream or a table; a null time or type is left out.
    """
    timed = events.where("ts is not null and event_type is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "mean", "n")
    )
