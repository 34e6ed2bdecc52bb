"""Connected components of an edge table by alternating large and small stars; each round is written to the shared folder and the one before deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import forget, written
from ._skew import lookup


#: Rounds of few edges aren't written as many tiny files.
ROWS_A_FILE = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the edges (u, v: longs); edges from a node to itself are fine."""
    pairs, path = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: u, larger than its neighbour v, moves to the smallest neighbour of v; a v with many neighbours is a heavy key
        large = lookup(pairs.withColumn("_v", F.col("v").cast("string")), least.select(F.col("u").cast("string").alias("_v"), "m", "n"), "_v", "n", "u")
        large = large.select("u", F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(smallest, "u")
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        files = max(1, seen[0] // ROWS_A_FILE)  # no more edges than before
        before = path
        pairs, path = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().coalesce(files), "edges")
        forget(edges.sparkSession, before)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
