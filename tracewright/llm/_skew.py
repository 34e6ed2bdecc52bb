"""Joins and sums that stay even when one key holds much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys joined by broadcast at most: those with most rows. Of n rows, no other key holds more than n / MOST_HOT.
MOST_HOT = 1000


def lookup(rows: DataFrame, groups: DataFrame, key: str, weight: str, spread: str, most_hot: int = MOST_HOT) -> DataFrame:
    """Left join of rows with groups, which has one row for each key and the key's number of rows in `weight`; key is a string, never null.

    The most_hot heaviest keys are broadcast, a bound that doesn't depend on the data; the others meet by shuffle, through which rows
    of the heavy keys go dealt by a hash of their column `spread`.
    """
    values = [c for c in groups.columns if c != key]
    hot = groups.orderBy(F.col(weight).desc(), F.col(key)).limit(most_hot)
    near = F.broadcast(hot.select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values)))
    # a heavy key's own row stays among these, where none of its rows goes
    cold = groups.select(F.concat(F.lit("="), key).alias("_meet"), *(F.col(c).alias(f"_cold_{c}") for c in values))
    dealt = F.when(F.col("_hot"), F.concat(F.lit("~"), F.xxhash64(spread).cast("string"))).otherwise(F.concat(F.lit("="), key))
    met = rows.join(near, key, "left").withColumn("_meet", dealt).join(cold, "_meet", "left")
    return met.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values))


def never_null(c: Column) -> Column:
    """A string key that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
