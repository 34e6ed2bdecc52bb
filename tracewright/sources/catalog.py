"""Dataset catalogs, readers of other layouts, and sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import read_frames

SAFE = re.compile(r"[^A-Za-z0-9_.-]+")


def sanitized(name: str) -> str:
    return SAFE.sub("_", name)


def output_path(root: str, *parts: str) -> str:
    """A path under root; parts are sanitized and may not step out of it."""
    for p in parts:
        if p in ("", ".", ".."):
            raise ValueError(f"{p!r} is no name")
    return "/".join([root.rstrip("/"), *map(sanitized, parts)])


def discover_recordings(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """Files under root as recording, token_matches, path and length; the recording is the name of the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    recording = F.element_at(parts, -2)
    return files.select("path", "length", recording.alias("recording"), name.alias("name"), F.size(F.filter(F.split(recording, "_"), lambda t: F.contains(name, t))).alias("token_matches"))


def best_files(files: DataFrame, kind: str, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """The file of each recording whose name has `kind`: most of the recording's tokens, then the shortest name, then the last."""
    order = Window.partitionBy(*keys).orderBy(F.desc("token_matches"), F.length("name"), F.desc("name"))
    return files.filter(F.contains("name", F.lit(kind))).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def variant_name(path: Column, root: str) -> Column:
    """Variant of a cleaned array's path below root: its folders and file name without endings, joined by slashes."""
    below = F.regexp_replace(F.regexp_replace(path, "^.*" + re.escape(root.strip("/")) + "/", ""), r"\.[A-Za-z0-9]+$", "")
    return F.array_join(F.filter(F.split(below, "/"), lambda p: ~p.isin("cleaned", "cleaned_variants")), "/")


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """2-D arrays (neurons by frames) of all files below path as path, time_index, x; files of any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    found = read_frames(spark, sorted(r["path"] for r in files.collect()), "neurons_by_frames")  # a row for each file
    return found.withColumn("time_index", F.col("time_index").cast("int"))


#: Fixed value: the key under which analysis-info files hold their sample rate.
RATE_KEY = "frameRateSCAPE"


def frame_rates(spark: SparkSession, path: str, default_hz: float, key: str = RATE_KEY) -> DataFrame:
    """Sample rate of each analysis-info JSON file; the default where it is missing, unreadable or not positive."""
    text = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    rate = F.get_json_object(F.col("content").cast("string"), f"$.{key}").try_cast("double")
    return text.select("path", F.when(rate > 0, rate).otherwise(default_hz).alias("sample_rate_hz"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every file under path, and whether another file has the same content."""
    from ..operators.setops import duplicate_flags

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return duplicate_flags(files.select("path", "length", F.sha2("content", 256).alias("sha256")), "sha256")


def write_variants(df: DataFrame, path: str, by: Sequence[str] = ("variant",)) -> None:
    """Partitioned by variant; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON document, written by Spark to any file system it knows."""
    spark.createDataFrame([(json.dumps(payload, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def stacked(tables: dict[str, DataFrame], key: str = "recording") -> DataFrame:
    """Tables with different columns under each other; the key column tells them apart and overwrites one of that name."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(key, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out
