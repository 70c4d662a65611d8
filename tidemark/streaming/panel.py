"""The hourly panel as a stream: late events within the watermark still count, each hour is emitted once it is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_panel(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    hours = timed.groupBy(F.window("ts", "1 hour")).agg(F.avg("value").alias("price"), F.count("*").alias("load"))
    return hours.select(F.col("window.start").alias("ts"), "price", "load")
