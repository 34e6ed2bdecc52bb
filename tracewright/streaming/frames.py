"""The frame-binning and smoothing operators over event streams. The batch operators define the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_stream(events: DataFrame, seconds: int, time: str = "ts", value: str = "value", key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Mean and root mean square of each key in tumbling event-time windows; rows later than `late` are dropped with their window."""
    window = F.window(time, f"{seconds} seconds")
    out = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.avg(value).alias("mean"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "mean", "rms", "n")
