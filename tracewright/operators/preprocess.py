"""Imputation, subsetting, resampling, smoothing, behaviour targets, lagged designs and standardization as DataFrame expressions.

All windows are partitioned by the keys of a recording, so no plan ever gathers a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, quantile


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df; raises if any row is bad."""
    if n := df.filter(bad).count():
        raise ValueError(f"{what}: {n} rows")
    return df


def impute_by_median(long: DataFrame, keys: Sequence[str] = ("recording", "neuron"), value: str = "value") -> DataFrame:
    """Non-finite values become the median of the finite ones of their series, or 0 if there are none."""
    clean = finite(value)
    medians = long.groupBy(*keys).agg(quantile(clean, 0.5).alias("_median"))
    return long.join(medians, list(keys)).withColumn(value, F.coalesce(clean, F.col("_median"), F.lit(0.0))).drop("_median")


def subset_cells(long: DataFrame, roles: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Keeps the cells listed in roles(keys, emitter, receiver: arrays), emitters first, each once, numbered in that order."""
    order = roles.select(*keys, F.posexplode(F.array_distinct(F.concat("emitter", "receiver"))).alias("_place", "_cell"))
    return long.join(order, list(keys)).filter(F.col("neuron") == F.col("_cell")).withColumn("neuron", F.col("_place")).drop("_place", "_cell")


def drop_bad_frames(wide: DataFrame, bad: DataFrame, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """Without the frames of bad(keys, time); survivors are numbered anew, the old number stays as original_frame."""
    left = wide.join(bad.select(*keys, time), [*keys, time], "left_anti")
    order = Window.partitionBy(*keys).orderBy(time)
    return left.withColumn("original_frame", F.col(time)).withColumn(time, (F.row_number().over(order) - 1).cast("int"))


def bin_edges(size: Column, n_frames: int, i: Column) -> Column:
    """Half-even rounded i-th of n_frames + 1 equally spaced edges."""
    return F.rint(i * size / F.lit(float(n_frames))).cast("long")


def bin_to_frames(signal: DataFrame, n_frames: int, reducers: Sequence[str] = ("mean",), keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Reduces a signal (sample_index, value) to n_frames bins; an empty bin takes its first sample. A sample's bin comes from arithmetic, not
    from a range join.
    """
    whole = Window.partitionBy(*keys)
    i = F.col("sample_index").cast("double")
    size = F.count(F.lit(1)).over(whole)
    sized = signal.withColumn("_n", size)
    guess = F.floor((i + 0.5) * n_frames / F.col("_n")).cast("int")
    lower = lambda b: bin_edges(F.col("_n"), n_frames, b)
    fits = [F.when((F.col("sample_index") >= lower(b)) & (F.col("sample_index") < lower(b + 1)), b) for b in (guess, guess - 1, guess + 1)]
    placed = sized.withColumn("frame", F.coalesce(*fits).cast("int"))
    how = {"mean": F.avg("value"), "median": quantile("value", 0.5), "rms": F.sqrt(F.avg(F.col("value") * F.col("value")))}
    filled = placed.groupBy(*keys, "frame").agg(*(how[r].alias(r) for r in reducers))
    grid = sized.select(*keys, "_n").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    first = F.least(bin_edges(F.col("_n"), n_frames, F.col("frame")), F.col("_n") - 1)
    grid = grid.withColumn("sample_index", first.cast("int"))
    one = signal.select(*keys, "sample_index", F.col("value").alias("_one"))
    out = grid.join(filled, [*keys, "frame"], "left").join(one, [*keys, "sample_index"], "left")
    single = {"mean": F.col("_one"), "median": F.col("_one"), "rms": F.abs("_one")}
    return out.select(*keys, "frame", *(F.coalesce(r, single[r]).alias(r) for r in reducers))


def first_difference(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str = "difference") -> DataFrame:
    """Change from the row before; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(value) - F.lag(value, 1).over(w)).withColumn(name, F.coalesce(name, F.lit(0.0)))


def moving_average(df: DataFrame, value: str, window: int, keys: Sequence[str], order: str, name: str | None = None) -> DataFrame:
    """Centered mean with the first and last values repeated beyond the edges; an even window reaches one further back."""
    if window <= 1:
        return df.withColumn(name or value, F.col(value).cast("double"))
    before, after = window // 2, window - 1 - window // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    inside = F.sum(value).over(w.rowsBetween(-before, after))
    total = inside + F.greatest(F.lit(0), before - (place - 1)) * F.first(value).over(whole) + F.greatest(F.lit(0), after - (n - place)) * F.last(value).over(whole)
    return df.withColumn(name or value, total / F.lit(float(window)))


def bout_threshold(df: DataFrame, value: str, q: float, keys: Sequence[str], override: str | None = None) -> DataFrame:
    """Threshold of each key: the quantile of all values, or of the positive ones (override positive_vigor_quantile)."""
    if override not in (None, "positive_vigor_quantile", "strict_zero_threshold"):
        raise ValueError(f"unknown override {override!r}")
    over = F.when(F.col(value) > 0, F.col(value)) if override == "positive_vigor_quantile" else F.col(value)
    return df.groupBy(*keys).agg(F.coalesce(quantile(over, q), F.lit(0.0)).alias("threshold"))


def bout_state(df: DataFrame, value: str, q: float, keys: Sequence[str], override: str | None = None) -> DataFrame:
    """1 where the value reaches its key's threshold; strict_zero_threshold asks for more than a threshold of exactly 0."""
    met = df.join(bout_threshold(df, value, q, keys, override), list(keys))
    above = F.col(value) >= F.col("threshold")
    if override == "strict_zero_threshold":
        above = F.when(F.col("threshold") == 0, F.col(value) > 0).otherwise(above)
    return met.withColumn("bout_state", above.cast("int"))


def behavior_targets(signal: DataFrame, n_frames: int, q: float = 0.75, smooth_window: int = 3, keys: Sequence[str] = ("recording",), override: str | None = None) -> DataFrame:
    """angle (mean of each bin), vigor (smoothed RMS of the change in each bin) and bout_state, from a signal (sample_index, value)."""
    angle = bin_to_frames(signal, n_frames, ("mean",), keys).withColumnRenamed("mean", "angle")
    change = first_difference(signal, "value", keys, "sample_index").select(*keys, "sample_index", F.col("difference").alias("value"))
    vigor = bin_to_frames(change, n_frames, ("rms",), keys).withColumnRenamed("rms", "raw_vigor")
    vigor = moving_average(vigor, "raw_vigor", smooth_window, keys, "frame", "vigor")
    return bout_state(angle.join(vigor, [*keys, "frame"]), "vigor", q, keys, override)


def target_grid(targets: DataFrame, quantiles: Sequence[float], windows: Sequence[int], keys: Sequence[str] = ("recording",)) -> DataFrame:
    """angle once, vigor for each window and bout_state for each quantile and window, stacked with their target_variant."""
    name = lambda kind, *more: F.lit("_".join([kind, *more]).replace(".", "p"))
    parts = [targets.select(*keys, "frame", F.lit("angle").alias("target_variant"), F.col("angle").alias("y"))]
    for w in dict.fromkeys(windows):
        smooth = moving_average(targets, "raw_vigor", w, keys, "frame", "_v")
        parts.append(smooth.select(*keys, "frame", name("vigor", f"sw{w}").alias("target_variant"), F.col("_v").alias("y")))
        for q in dict.fromkeys(quantiles):
            state = bout_state(smooth.drop("bout_state", "threshold"), "_v", q, keys)
            parts.append(state.select(*keys, "frame", name("bout", f"q{q:g}", f"sw{w}").alias("target_variant"), F.col("bout_state").cast("double").alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lagged_design(wide: DataFrame, lags: Sequence[int], shift: int = 0, target: str | None = None, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """x of each lag side by side as `features`, and the target `shift` frames ahead, where all of them exist."""
    w = Window.partitionBy(*keys).orderBy(time)
    parts = [F.lag("x", lag).over(w) if lag else F.col("x") for lag in sorted(set(lags))]
    out = wide.withColumn("features", F.concat(*parts))
    if target:
        out = out.withColumn("y", F.lead(target, shift).over(w) if shift else F.col(target)).filter(F.col("y").isNotNull())
    return out.filter(F.col("features").isNotNull())


def paired_windows(wide: DataFrame, window: int, shift: int = 0, target: str | None = None, keys: Sequence[str] = ("recording",), time: str = "time_index") -> DataFrame:
    """Flattened histories of window - 1 frames ending at a frame (x0) and at the next (x1), with the target at that frame + shift."""
    if window < 2:
        raise ValueError("a window needs two frames")
    w = Window.partitionBy(*keys).orderBy(time)
    held = F.collect_list("x").over(w.rowsBetween(-(window - 2), 0))
    out = wide.withColumn("_held", held).withColumn("_full", F.size("_held") == window - 1).withColumn("x0", F.flatten("_held"))
    out = out.withColumn("x1", F.lead("x0", 1).over(w))
    if target:
        out = out.withColumn("y", F.lead(target, shift).over(w) if shift else F.col(target)).filter(F.col("y").isNotNull())
    return out.filter(F.col("_full") & F.col("x1").isNotNull()).drop("_held", "_full")


def standardize_by_train(long: DataFrame, is_train: Column, keys: Sequence[str], value: str = "value", name: str = "z") -> DataFrame:
    """z by the mean and population deviation of the training rows; a deviation of 0 counts as 1."""
    own = F.when(is_train, F.col(value))
    fit = long.groupBy(*keys).agg(F.avg(own).alias("_mean"), F.stddev_pop(own).alias("_std"))
    z = (F.col(value) - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return long.join(fit, list(keys)).withColumn(name, z).drop("_mean", "_std")


def interpolate_window(long: DataFrame, centers: DataFrame, half_width: int, keys: Sequence[str] = ("recording",), series: Sequence[str] = ("neuron",), time: str = "time_index") -> DataFrame:
    """For each center(keys, center): values of the frames around it and a line through the frames just outside; null without both."""
    t = F.col(time)
    met = long.join(centers, list(keys)).filter(F.abs(t - F.col("center")) <= half_width + 1)
    by = Window.partitionBy(*keys, "center", *series)
    left = F.max(F.when(t == F.col("center") - half_width - 1, F.col("value"))).over(by)
    right = F.max(F.when(t == F.col("center") + half_width + 1, F.col("value"))).over(by)
    weight = (t - (F.col("center") - half_width - 1)) / F.lit(float(2 * half_width + 2))
    return met.withColumn("interpolated", left + (right - left) * weight).filter(F.abs(t - F.col("center")) <= half_width)


def resample_linear(signal: DataFrame, n_frames: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """The signal at n_frames equally spaced places from its first to its last sample, linearly between samples."""
    sizes = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grid = sizes.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    place = F.col("frame") * (F.col("_n") - 1) / F.lit(float(max(1, n_frames - 1)))
    grid = grid.withColumn("_at", place).withColumn("_low", F.floor("_at").cast("int")).withColumn("_high", F.least(F.floor("_at") + 1, F.col("_n") - 1).cast("int"))
    low = signal.select(*keys, F.col("sample_index").alias("_low"), F.col("value").alias("_a"))
    high = signal.select(*keys, F.col("sample_index").alias("_high"), F.col("value").alias("_b"))
    met = grid.join(low, [*keys, "_low"]).join(high, [*keys, "_high"])
    return met.select(*keys, "frame", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_low"))).alias("value"))


def marks_to_edges(marks: DataFrame) -> DataFrame:
    """Directed edges of marks(source, target, lag, mark): those that point to the target only, over all lags."""
    return marks.filter(F.col("mark").contains(">") & ~F.col("mark").contains("<")).select("source", "target").distinct()


def binary_edges(edges: DataFrame) -> DataFrame:
    """Nonzero edges of edges(.., source, target, weight) off the diagonal, with weight 1."""
    return edges.filter((F.col("source") != F.col("target")) & (F.col("weight") != 0)).withColumn("weight", F.lit(1))


def order_variants(df: DataFrame, reference: str, methods: Sequence[str], variant: str = "variant") -> DataFrame:
    """Reference first, then methods in their order by substring, then by name."""
    place = F.lit(len(methods))
    for i in range(len(methods) - 1, -1, -1):
        place = F.when(F.col(variant).contains(methods[i]), i).otherwise(place)
    return df.withColumn("variant_order", F.when(F.col(variant) == reference, -1).otherwise(place).cast("int")).orderBy("variant_order", variant)


def busiest_window(df: DataFrame, value: str, length: int, keys: Sequence[str], order: str) -> DataFrame:
    """Start of the window of `length` rows with the largest sum; the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(order)
    sums = df.withColumn("_sum", F.sum(value).over(w.rowsBetween(0, length - 1))).withColumn("_n", F.count(F.lit(1)).over(w.rowsBetween(0, length - 1)))
    return sums.filter(F.col("_n") == length).groupBy(*keys).agg(F.max(F.struct(F.col("_sum"), -F.col(order))).alias("_best")).select(*keys, (-F.col("_best.col2")).alias("window_start"), F.col("_best._sum").alias("window_sum"))
