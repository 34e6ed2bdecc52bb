"""Exact sign flips in SQL; block bootstrap and permutation as grouped functions over blocks' summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.draws import hashed

MOST_UNITS = 20


def exact_sign_flip(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Two-sided p of the mean under all sign flips of up to MOST_UNITS differences: the share of flips at least as far from 0. More raise an error."""
    held = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_d"))
    too_many = F.raise_error(F.lit(f"exact sign flips take {MOST_UNITS} differences at most"))
    held = held.withColumn("_n", F.when(F.size("_d") > MOST_UNITS, too_many).otherwise(F.size("_d")))
    flips = held.withColumn("_f", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("_n")).cast("long") - 1)))
    bits = F.transform("_d", lambda x, i: F.when(F.pmod(F.floor(F.col("_f") / F.pow(F.lit(2.0), i)), F.lit(2)) == 1, -x).otherwise(x))
    total = F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)
    observed = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x)
    out = flips.withColumn("_hit", (F.abs(total) >= F.abs(observed) - 1e-12).cast("int"))
    return out.groupBy(*keys).agg((F.sum("_hit") / F.count(F.lit(1))).alias("p_sign_flip"))


def block_means(df: DataFrame, value: str, keys: Sequence[str], block: Sequence[str]) -> DataFrame:
    """n and sum of each block: all that resampling of whole blocks needs, so groups stay small whatever the rows."""
    return df.groupBy(*keys, *block).agg(F.count(F.col(value)).alias("n"), F.sum(value).alias("total"))


def block_inference(df: DataFrame, value: str, keys: Sequence[str], block: Sequence[str] = ("block",), n_bootstrap: int = 2000, n_permutations: int = 5000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean of the differences, percentile interval of a block bootstrap, and p = (exceeding + 1) / (draws + 1) of block sign flips.

    Draw d of block b (in order) is hashed(d, b): block number modulo the blocks for the bootstrap (seed 2 * seed), sign by the last bit (2 * seed + 1).
    """
    rows = block_means(df, value, keys, block)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n long, n_blocks long, mean double, low double, high double, p double"

    def infer(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(list(block))
        n, total = own["n"].to_numpy(float), own["total"].to_numpy(float)
        mean = total.sum() / n.sum()
        pick = (hashed(n_bootstrap, len(n), 2 * seed) % np.uint64(len(n))).astype(np.int64)
        boot = total[pick].sum(axis=1) / n[pick].sum(axis=1)
        flips = 1.0 - 2.0 * (hashed(n_permutations, len(n), 2 * seed + 1) & np.uint64(1)).astype(float)
        p = (np.sum(np.abs(flips @ total) >= abs(total.sum()) * (1 - 1e-9)) + 1) / (n_permutations + 1)
        low, high = np.quantile(boot, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({**{k: [own[k].iloc[0]] for k in keys}, "n": int(n.sum()), "n_blocks": len(n), "mean": mean, "low": low, "high": high, "p": p})

    return rows.filter("n > 0").groupBy(*keys).applyInPandas(infer, schema)


def prediction_uncertainty(paired: DataFrame, task: str, keys: Sequence[str], block: Sequence[str] = ("block",), **draws: int) -> DataFrame:
    """Advantage over the reference prediction y_ref: less squared error (regression) or more correct labels (classification)."""
    if task == "regression":
        gain = (F.col("y_ref") - F.col("y_true")) ** 2 - (F.col("y_pred") - F.col("y_true")) ** 2
    else:
        gain = (F.col("y_pred") == F.col("y_true")).cast("double") - (F.col("y_ref") == F.col("y_true")).cast("double")
    return block_inference(paired.withColumn("_gain", gain), "_gain", keys, block, **draws)
