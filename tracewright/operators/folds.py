"""Blocked folds, leak-free masks, null targets, segments and the leakage audit."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.draws import NULL_STRATEGIES, null_order


def fold_edges(frames: DataFrame, n_splits: int, gap: int = 0, keys: Sequence[str] = ("recording",), time: str = "time_index", required_gap: int = 0) -> DataFrame:
    """fold, n, start and stop of each contiguous test block, by half-even rounded equal edges."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    if gap < required_gap:
        raise ValueError(f"gap {gap} is under the required {required_gap}")
    sizes = frames.groupBy(*keys).agg((F.max(time) + 1).cast("int").alias("n"))
    edge = lambda i: F.rint(i * F.col("n") / F.lit(float(n_splits))).cast("int")
    folds = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return folds.select(*keys, "fold", "n", edge(F.col("fold")).alias("start"), edge(F.col("fold") + 1).alias("stop"), F.lit(gap).alias("gap"))


def fold_role(time: Column | str = "time_index") -> Column:
    """test inside the block, gap within `gap` frames of it, train elsewhere."""
    t = F.col(time) if isinstance(time, str) else time
    test = (t >= F.col("start")) & (t < F.col("stop"))
    train = (t < F.col("start") - F.col("gap")) | (t >= F.col("stop") + F.col("gap"))
    return F.when(test, "test").when(train, "train").otherwise("gap")


def strict_folds(frames: DataFrame, n_splits: int, gap: int, keys: Sequence[str] = ("recording",), time: str = "time_index", required_gap: int = 0) -> DataFrame:
    """Every frame's role in every fold."""
    edges = fold_edges(frames, n_splits, gap, keys, time, required_gap)
    return frames.select(*keys, time).distinct().join(edges, list(keys)).withColumn("role", fold_role(time))


def _inside(first: Column, last: Column, part: str) -> Column:
    """Whether all frames first .. last are of that role; blocks are contiguous, so the ends tell."""
    if part == "test":
        return (first >= F.col("start")) & (last < F.col("stop"))
    low, high = F.col("start") - F.col("gap"), F.col("stop") + F.col("gap")
    return (last < low) | (first >= high)


def decoding_masks(frames: DataFrame, edges: DataFrame, lags: Sequence[int], shift: int, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """Rows for fits and tests that share no frame: train if target and all lagged frames are training frames, test if the target is a test
    frame and no lagged frame is a training frame.
    """
    t = F.col(time)
    target, deep = t + shift, max(lags)
    met = frames.join(edges, list(keys)).filter((t >= deep) & (target < F.col("n")))
    low, high = F.col("start") - F.col("gap"), F.col("stop") + F.col("gap")
    lagged = [t - lag for lag in sorted(set(lags))]
    all_train = _inside(target, target, "train")
    none_train = _inside(target, target, "test")
    for x in lagged:
        all_train = all_train & ((x < low) | (x >= high))
        none_train = none_train & (x >= low) & (x < high)
    return met.withColumn("role", F.when(all_train, "train").when(none_train, "test")).filter(F.col("role").isNotNull())


def causal_masks(frames: DataFrame, edges: DataFrame, window: int, shift: int, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """The same for windows that reach from window - 2 frames before the anchor to one after it; a test anchor is a test frame too."""
    t = F.col(time)
    first, last, target = t - (window - 2), t + 1, t + shift
    low, high = F.col("start") - F.col("gap"), F.col("stop") + F.col("gap")
    met = frames.join(edges, list(keys)).filter((first >= 0) & (last < F.col("n")) & (target < F.col("n")) & (target >= 0))
    spans = F.sequence(F.lit(-(window - 2)), F.lit(1))
    train_frame = lambda x: (x < low) | (x >= high)
    all_train = F.forall(spans, lambda o: train_frame(t + o)) & train_frame(target)
    test = _inside(t, t, "test") & _inside(target, target, "test") & ~F.exists(spans, lambda o: train_frame(t + o))
    return met.withColumn("role", F.when(all_train, "train").when(test, "test")).filter(F.col("role").isNotNull())


def segments(df: DataFrame, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """segment of each row: runs of consecutive times are numbered from 0."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.when(F.col(time) - F.lag(time, 1).over(w) == 1, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("segment", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def blocks_in_segments(df: DataFrame, block_size: int, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """block of each row: block_size rows of one segment."""
    w = Window.partitionBy(*keys, "segment").orderBy(time)
    return segments(df, keys, time).withColumn("block", F.floor((F.row_number().over(w) - 1) / block_size).cast("int"))


def null_targets(df: DataFrame, value: str, strategy: str, block_size: int = 10, seed: int = 0, min_shift: int = 1, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """`null_value` beside each row: its series in shuffled blocks (that never span a time gap) or circularly shifted by min_shift or more."""
    if strategy not in NULL_STRATEGIES:
        raise ValueError(f"unknown null strategy {strategy!r}")
    columns = [*keys, time, value]

    def shuffled(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(time, kind="stable").reset_index(drop=True)
        return own.assign(null_value=own[value].to_numpy()[null_order(own[time].to_numpy(), strategy, seed, block_size, min_shift)])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + f", null_value {types[value]}"
    return df.select(*columns).groupBy(*keys).applyInPandas(shuffled, schema)


def leakage_audit(fits: DataFrame, roles: DataFrame, keys: Sequence[str] = ("recording", "fold"), time: str = "time_index") -> DataFrame:
    """For each operation of fits(operation, keys, time): fit rows, those of the test block and whether it is leakage_free."""
    met = fits.join(roles.select(*keys, time, "role"), [*keys, time], "left")
    overlap = F.count_if(F.coalesce(F.col("role") == "test", F.lit(False)))
    return met.groupBy("operation", *keys).agg(F.count(F.lit(1)).alias("n_fit"), overlap.alias("n_overlap")).withColumn("leakage_free", F.col("n_overlap") == 0)


def assert_leak_free(audit: DataFrame) -> DataFrame:
    if bad := audit.filter(~F.col("leakage_free")).limit(5).collect():
        raise AssertionError(f"test rows were used in fits: {bad}")
    return audit
