"""Component quality: temporal, loading and behaviour features, scores, flags and removal validation in SQL; spectra by grouped Welch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAD_SCALE, finite, median, pearson, quantile, safe_divide
from .metrics import percent_rank_average

EPS = 2.220446049250313e-16
COMPONENT = ("recording", "component")


@dataclass(frozen=True)
class FeatureConfig:
    # Defaults of the evidence features.
    low_freq_max_hz: float = 0.5
    high_freq_min_hz: float = 3.0
    robust_peak_z: float = 6.0
    strong_loading_z: float = 3.0
    window_count: int = 4


@dataclass(frozen=True)
class ScoringConfig:
    # Thresholds of recommendations and flags.
    artifact_drop: float = 0.70
    artifact_review: float = 0.55
    protect_drop_max: float = 0.45
    protect_keep: float = 0.60
    high_freq_ratio: float = 0.35
    robust_peak_density: float = 0.02
    abs_kurtosis: float = 5.0
    variance_ratio: float = 5.0
    loading_ratio: float = 10.0
    behavior_corr: float = 0.2
    low_freq_ratio: float = 0.6
    lag1_autocorr: float = 0.4
    artifact_columns: tuple[str, ...] = ("high_freq_power_ratio", "robust_peak_density", "abs_excess_kurtosis", "window_variance_ratio", "max_median_loading_ratio", "narrowband_ratio")
    protect_columns: tuple[str, ...] = ("low_freq_power_ratio", "lag1_autocorr", "max_abs_behavior_corr", "stability_score")


def temporal_features(series: DataFrame, config: FeatureConfig = FeatureConfig(), keys: Sequence[str] = COMPONENT, time: str = "time_index", value: str = "value") -> DataFrame:
    """Variance, kurtosis, robust peaks, autocorrelation at 1, 5 and 10, variance over windows and zero crossings of each series."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(time)
    v = F.col(value)
    centers = series.groupBy(*keys).agg(median(value).alias("_median"), F.avg(value).alias("_mean"))
    own = series.join(centers, list(keys)).withColumn("_dev", F.abs(v - F.col("_median")))
    mads = own.groupBy(*keys).agg((MAD_SCALE * median("_dev")).alias("_mad"))
    own = own.join(mads, list(keys)).withColumn("_z", F.col("_dev") / F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(EPS))
    own = own.withColumn("_sign", v - F.col("_mean") < 0)
    own = own.withColumns({"_before": F.lag("_sign", 1).over(order), **{f"_lag{k}": F.lag(value, k).over(order) for k in (1, 5, 10)}, "_window": F.ntile(config.window_count).over(order)})
    crossed = F.when(F.col("_before").isNotNull(), (F.col("_sign") != F.col("_before")).cast("int"))
    kurtosis = F.when(F.var_pop(value) > 0, F.coalesce(F.kurtosis(value), F.lit(-3.0))).otherwise(-3.0)
    out = own.groupBy(*keys).agg(
        F.var_pop(value).alias("ic_variance"), F.stddev_pop(value).alias("ic_std"), kurtosis.alias("excess_kurtosis"),
        F.avg((F.col("_z") >= config.robust_peak_z).cast("int")).alias("robust_peak_density"), F.max("_z").alias("max_abs_robust_z"),
        *(F.coalesce(pearson(value, f"_lag{k}"), F.lit(0.0)).alias(f"lag{k}_autocorr") for k in (1, 5, 10)),
        F.coalesce(F.avg(crossed), F.lit(0.0)).alias("zero_crossing_rate"),
    )
    spread = own.groupBy(*keys, "_window").agg(F.var_pop(value).alias("_var")).groupBy(*keys).agg((F.max("_var") / F.greatest(F.min("_var"), F.lit(EPS))).alias("window_variance_ratio"))
    return out.join(spread, list(keys)).withColumn("abs_excess_kurtosis", F.abs("excess_kurtosis"))


def loading_features(mixing: DataFrame, config: FeatureConfig = FeatureConfig(), keys: Sequence[str] = COMPONENT, positions: DataFrame | None = None) -> DataFrame:
    """L1, L2, Hoyer sparsity, largest to median and strong share of mixing(keys, neuron, weight); spatial extent with positions(neuron, x, y)."""
    a = mixing.withColumn("_a", F.abs("weight"))
    centers = a.groupBy(*keys).agg(median("_a").alias("_median"))
    a = a.join(centers, list(keys))
    mads = a.groupBy(*keys).agg((MAD_SCALE * median(F.abs(F.col("_a") - F.col("_median")))).alias("_mad"))
    a = a.join(mads, list(keys)).withColumn("_mad", F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(EPS))
    n, l1, l2 = F.count(F.lit(1)), F.sum("_a"), F.sqrt(F.sum(F.col("_a") * F.col("_a")))
    out = a.groupBy(*keys).agg(
        l1.alias("loading_l1"), l2.alias("loading_l2"), n.alias("_n"), F.max("_a").alias("_max"), F.first("_median").alias("_median"),
        F.avg((F.col("_a") >= F.col("_median") + config.strong_loading_z * F.col("_mad")).cast("int")).alias("strong_loading_fraction"),
    )
    root = F.sqrt(F.col("_n").cast("double"))
    hoyer = F.when((F.col("_n") > 1) & (F.col("loading_l2") > 0), (root - F.col("loading_l1") / F.when(F.col("loading_l2") > 0, F.col("loading_l2"))) / F.when(F.col("_n") > 1, root - 1)).otherwise(0.0)
    out = out.withColumns({"loading_hoyer_sparsity": hoyer, "max_median_loading_ratio": F.col("_max") / F.greatest("_median", F.lit(EPS))}).drop("_n", "_max", "_median")
    if positions is None:
        return out
    placed = a.join(positions, "neuron")
    mid = placed.groupBy(*keys).agg(*(safe_divide(F.sum(F.col("_a") * F.col(c)), F.sum("_a")).alias(f"_{c}") for c in ("x", "y")))
    far = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2
    extent = placed.join(mid, list(keys)).groupBy(*keys).agg(F.sqrt(safe_divide(F.sum(F.col("_a") * far), F.sum("_a"))).alias("weighted_spatial_extent"))
    return out.join(extent, list(keys), "left")


def behavior_features(series: DataFrame, targets: DataFrame, names: Sequence[str], keys: Sequence[str] = COMPONENT, on: Sequence[str] = ("recording", "time_index"), value: str = "value") -> DataFrame:
    """Correlation of each series with each target (0 where undefined) and the largest of them in size."""
    met = series.join(targets.select(*on, *(F.col(t).alias(f"_{t}") for t in names)), list(on))
    out = met.groupBy(*keys).agg(*(F.coalesce(pearson(value, f"_{t}"), F.lit(0.0)).alias(f"behavior_corr_{t}") for t in names))
    sizes = [F.abs(f"behavior_corr_{t}") for t in names]
    return out.withColumn("max_abs_behavior_corr", F.greatest(*sizes) if len(sizes) > 1 else sizes[0])


def spectral_features(spectra: DataFrame, config: FeatureConfig = FeatureConfig(), keys: Sequence[str] = COMPONENT) -> DataFrame:
    """Total power, peak, low and high shares, normalized entropy and narrowband ratio of spectra(keys, frequency, power)."""
    bins = spectra.select(*keys, F.posexplode(F.arrays_zip("frequency", "power")).alias("_i", "_b")).select(*keys, "_i", F.col("_b.frequency").alias("_f"), F.col("_b.power").alias("_p"))
    total = bins.groupBy(*keys).agg(F.when(F.sum("_p") > 0, F.sum("_p")).otherwise(EPS).alias("spectral_total_power"), F.count(F.lit(1)).alias("_n"))
    d = bins.join(total, list(keys)).withColumn("_d", F.col("_p") / F.col("spectral_total_power"))
    out = d.groupBy(*keys).agg(
        F.first("spectral_total_power").alias("spectral_total_power"), F.max(F.struct("_p", -F.col("_i"), "_f")).alias("_peak"),
        F.coalesce(F.sum(F.when(F.col("_f") <= config.low_freq_max_hz, F.col("_d"))), F.lit(0.0)).alias("low_freq_power_ratio"),
        F.coalesce(F.sum(F.when(F.col("_f") >= config.high_freq_min_hz, F.col("_d"))), F.lit(0.0)).alias("high_freq_power_ratio"),
        (-F.sum(F.col("_d") * F.log2(F.greatest("_d", F.lit(EPS)))) / F.log2(F.greatest(F.first("_n"), F.lit(2)).cast("double"))).alias("spectral_entropy"),
        (F.max("_p") / F.greatest(median("_p"), F.lit(EPS))).alias("narrowband_ratio"),
    )
    return out.withColumn("peak_freq_hz", F.col("_peak._f")).drop("_peak")


def scored(features: DataFrame, config: ScoringConfig = ScoringConfig(), keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Artifact and protection scores, flags and a drop, review or keep recommendation for each component of a recording.

    A score is the mean percent rank over its columns, missing values taking the column's median; columns that the table lacks are skipped.
    """
    out = features
    for name, columns in (("artifact_score", config.artifact_columns), ("protect_score", config.protect_columns)):
        there = [c for c in columns if c in features.columns]
        if not there:
            out = out.withColumn(name, F.lit(0.0))
            continue
        medians = out.groupBy(*keys).agg(*(quantile(finite(c), 0.5).alias(f"_m_{c}") for c in there))
        out = out.join(medians, list(keys)).withColumns({f"_f_{c}": F.coalesce(finite(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in there})
        ranks = [percent_rank_average(f"_f_{c}", keys) for c in there]
        out = out.withColumn(name, sum(ranks[1:], ranks[0]) / F.lit(float(len(there)))).drop(*(f"_m_{c}" for c in there), *(f"_f_{c}" for c in there))
    value = lambda c: F.coalesce(finite(c), F.lit(0.0)) if c in features.columns else F.lit(0.0)

    def flags(pairs: Sequence[tuple[str, str, float]]) -> Column:
        return F.array_join(F.filter(F.array(*(F.when(value(c) >= limit, name) for name, c, limit in pairs)), lambda x: x.isNotNull()), ";")

    a, p = F.col("artifact_score"), F.col("protect_score")
    label = F.when((a >= config.artifact_drop) & (p <= config.protect_drop_max), "drop").when((p >= config.protect_keep) & (a < config.artifact_drop), "keep")
    label = label.when((a >= config.artifact_review) | (p >= config.protect_keep), "review").otherwise("keep")
    c = config
    # Names of the flags.
    artifact = [
        ("high_frequency", "high_freq_power_ratio", c.high_freq_ratio), ("bursty", "robust_peak_density", c.robust_peak_density), ("heavy_tailed", "abs_excess_kurtosis", c.abs_kurtosis),
        ("nonstationary", "window_variance_ratio", c.variance_ratio), ("concentrated_loading", "max_median_loading_ratio", c.loading_ratio),
    ]
    protect = [
        ("behavior_link", "max_abs_behavior_corr", c.behavior_corr), ("slow_calcium_band", "low_freq_power_ratio", c.low_freq_ratio), ("autocorrelated", "lag1_autocorr", c.lag1_autocorr),
        ("stable_across_runs", "stability_score", c.protect_keep),
    ]
    return out.withColumns({"artifact_flags": flags(artifact), "protect_flags": flags(protect), "recommendation": label})


def ordered(table: DataFrame) -> DataFrame:
    """Drop first, then review and keep; strongest artifacts first, least protected first."""
    place = F.when(F.col("recommendation") == "drop", 0).when(F.col("recommendation") == "review", 1).otherwise(2)
    return table.orderBy(place, F.desc("artifact_score"), "protect_score", "component")


def select_by_quality(table: DataFrame, strategy: str) -> DataFrame:
    """Components that aren't dropped (ic_quality_nonartifact) or that are kept outright (ic_quality_strict_keep)."""
    if strategy not in ("ic_quality_nonartifact", "ic_quality_strict_keep"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return table.filter(F.col("recommendation") == "keep" if strategy == "ic_quality_strict_keep" else F.col("recommendation") != "drop")


def removal_validation(components: DataFrame, mixing: DataFrame, reference: DataFrame, groups: DataFrame, keys: Sequence[str] = ("recording",), chunk: int = 1024) -> DataFrame:
    """What removing each group(keys, group, component) of components does: removal only subtracts its own part, so nothing else is rebuilt.

    reference(keys, time_index, neuron, value); the full reconstruction is compared with it before and after. A component without a value at a
    time adds nothing there, and cells without a reference value are left out. A task takes `chunk` frames, makes each group's part of them by
    one product of matrices, and returns sums for each neuron, so rows grow with frames and not with their products with components.
    """
    on, part = list(keys), F.floor(F.col("time_index") / chunk).cast("int").alias("part")
    long = lambda df, c, is_reference: df.select(*on, part, "time_index", F.col(c).cast("int").alias("i"), F.col("value").cast("double").alias("value"), F.lit(is_reference).alias("is_reference"))
    cells = long(components, "component", False).unionByName(long(reference, "neuron", True)).filter("value IS NOT NULL")
    of_component = groups.groupBy(*on, "component").agg(F.collect_set("group").alias("groups"))
    loads = mixing.groupBy(*on, "component").agg(F.sort_array(F.collect_list(F.struct(F.col("neuron").cast("int").alias("neuron"), F.col("weight").cast("double").alias("weight")))).alias("_l"))
    model = loads.join(of_component, [*on, "component"], "left").select(*on, F.col("component").cast("int").alias("component"), F.col("_l.neuron").alias("neuron"), F.col("_l.weight").alias("weight"), "groups")
    model = model.join(cells.select(*on, "part").distinct(), on)
    model = model.toDF(*model.columns)  # columns of its own, as both sides come from cells
    # fmt: off
    sums = ["n", "abs_gone", "gone_gone", "ref", "ref_ref", "full", "full_full", "left", "left_left", "ref_full", "ref_left"]
    # fmt: on

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        columns = [*on, "group", "neuron", *sums]
        if own.empty or model.empty:
            return pd.DataFrame({c: [] for c in columns})
        time, row = np.unique(own["time_index"].to_numpy(), return_inverse=True)
        is_ref, i, value = own["is_reference"].to_numpy(bool), own["i"].to_numpy(), own["value"].to_numpy()
        known, neurons = model["component"].to_numpy(), np.unique(np.concatenate(model["neuron"].to_list()))
        weight = np.zeros((len(known), len(neurons)))
        for k, (at, w) in enumerate(zip(model["neuron"], model["weight"], strict=True)):
            weight[k, np.searchsorted(neurons, at)] = w
        z, ref = np.zeros((len(time), len(known))), np.full((len(time), len(neurons)), np.nan)
        column = {int(c): k for k, c in enumerate(known)}
        place = np.array([column.get(int(c), -1) for c in i[~is_ref]], int)
        z[row[~is_ref][place >= 0], place[place >= 0]] = value[~is_ref][place >= 0]
        inside = is_ref & np.isin(i, neurons)
        ref[row[inside], np.searchsorted(neurons, i[inside])] = value[inside]
        there = ~np.isnan(ref)
        ref, full = np.where(there, ref, 0.0), np.where(there, z @ weight, 0.0)
        members: dict = {}
        for k, some in enumerate(model["groups"]):
            for g in some if some is not None else ():
                members.setdefault(g, []).append(k)
        out = []
        for g, of_group in members.items():
            gone = np.where(there, z[:, of_group] @ weight[of_group], 0.0)
            left = full - gone
            of_neuron = [there, np.abs(gone), gone * gone, ref, ref * ref, full, full * full, left, left * left, ref * full, ref * left]
            out.append(pd.DataFrame({c: [own[c].iloc[0]] * len(neurons) for c in on} | {"group": [g] * len(neurons), "neuron": neurons} | {s: v.sum(axis=0).astype(float) for s, v in zip(sums, of_neuron, strict=True)}))
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    types = {f.name: f.dataType.simpleString() for f in cells.schema} | {"group": groups.schema["group"].dataType.simpleString()}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*on, "group"]) + ", neuron int, " + ", ".join(f"`{s}` double" for s in sums)
    by_part = [*on, "part"]
    partial = cells.groupBy(*by_part).cogroup(model.groupBy(*by_part)).applyInPandas(run, schema)

    def spread(c: str) -> Column:
        """Population variance from sums; 0 where nothing but rounding is left."""
        square = F.col(f"{c}_{c}") / F.col("n")
        v = square - F.pow(F.col(c) / F.col("n"), 2)
        return F.when(v > 1e-13 * square, v).otherwise(0.0)

    def corr(other: str) -> Column:
        scale = F.sqrt(spread("ref") * spread(other))
        return F.coalesce(safe_divide(F.col(f"ref_{other}") / F.col("n") - F.col("ref") * F.col(other) / (F.col("n") * F.col("n")), F.when(scale > 0, scale)), F.lit(0.0))

    of_neuron = partial.groupBy(*on, "group", "neuron").agg(*(F.sum(s).alias(s) for s in sums)).filter("n > 0")
    of_neuron = of_neuron.withColumn("_r", spread("left") / F.greatest(spread("ref"), F.lit(EPS)))
    out = of_neuron.groupBy(*on, "group").agg(*(F.sum(s).alias(s) for s in sums), median("_r").alias("variance_ratio_median_removed")).select(
        *on, "group", (F.col("abs_gone") / F.col("n")).alias("mean_abs_delta"), F.sqrt(F.col("gone_gone") / F.col("n")).alias("rms_delta"),
        corr("full").alias("reference_corr_full"), corr("left").alias("reference_corr_removed"), "variance_ratio_median_removed",
    )
    return out.withColumn("reference_corr_delta", F.col("reference_corr_removed") - F.col("reference_corr_full"))
