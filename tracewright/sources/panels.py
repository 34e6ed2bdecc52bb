"""Trace panels as long tables: traces(recording, variant, time_index, neuron, value), frames with one array for each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, length: int = FRAMES) -> DataFrame:
    """Vectors in id order as recordings of `length` frames: recording, time_index, x."""
    rows = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rows.select(F.floor(F.col("vec_id") / length).cast("int").alias("recording"), (F.col("vec_id") % length).cast("int").alias("time_index"), x.alias("x"), (F.col("label") >= 5).cast("int").alias("bout_state"), F.col("label").cast("double").alias("level"))


def long_form(wide: DataFrame, keys: tuple[str, ...] = ("recording", "time_index")) -> DataFrame:
    return wide.select(*keys, F.posexplode("x").alias("neuron", "value"))


def traces(spark: SparkSession, sf_dir: str, length: int = FRAMES) -> DataFrame:
    return long_form(frames(spark, sf_dir, length))


def wide_form(long: DataFrame, keys: tuple[str, ...] = ("recording", "time_index")) -> DataFrame:
    """One array of values in neuron order for each key."""
    pairs = F.array_sort(F.collect_list(F.struct("neuron", "value")))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("x"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of each user in time order: recording, sample_index, value."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), (F.row_number().over(order) - 1).cast("int").alias("sample_index"), F.col("value").cast("double").alias("value"))
