"""Set comparisons, duplicate flags and cumulative selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_divide


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|; 1 for two empty arrays."""
    return F.coalesce(safe_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))


def complement(accepted: Column, n: Column | int) -> Column:
    """The numbers 0 .. n - 1 that aren't accepted."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_except(F.sequence(F.lit(0), n - 1), accepted)


def duplicate_flags(df: DataFrame, key: str) -> DataFrame:
    """copies of each row's key and whether there are others. Counts are pre-aggregated, so a key with many rows isn't gathered."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")), key).withColumn("is_duplicate", F.col("copies") > 1)


def first_reaching(df: DataFrame, value: str, tie: str, share: float, keys: Sequence[str]) -> DataFrame:
    """n, how many of the largest values are needed to reach that share of the total, and the share reached."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    run = safe_divide(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(Window.partitionBy(*keys)))
    placed = df.withColumns({"_place": F.row_number().over(w), "_share": run})
    reached = placed.filter(F.col("_share") >= share).groupBy(*keys).agg(F.min("_place").alias("n"), F.min("_share").alias("reached"))
    return reached


def adjusted_rand(rows: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Agreement of two labelings from their contingency counts; NULL if it is undefined."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / F.lit(2.0))
    cells = rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    both = cells.groupBy(*keys).agg(pairs("_n").alias("_i"), F.sum("_n").alias("_all"))
    one, two = (cells.groupBy(*keys, c).agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(pairs("_n").alias(f"_{c}_pairs")) for c in (a, b))
    met = both.join(one, list(keys)).join(two, list(keys))
    p, q, total = F.col(f"_{a}_pairs"), F.col(f"_{b}_pairs"), F.col("_all") * (F.col("_all") - 1) / 2.0
    chance = safe_divide(p * q, total)
    return met.select(*keys, safe_divide(F.col("_i") - chance, (p + q) / 2.0 - chance).alias("adjusted_rand"))
