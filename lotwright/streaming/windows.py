"""Event-time windows and first sights over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Count and sum of value per hour and event type; an hour is emitted when the watermark passes its end."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counted = rows.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def first_sights(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first row of each event_id within the watermark: repeated deliveries are dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return rows.dropDuplicatesWithinWatermark(["event_id"])
