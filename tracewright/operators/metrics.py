"""Preservation, regression, classification and effect metrics as aggregate expressions; undefined values are NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import median, pearson, positive_ratio, quantile, r_squared, rmse, safe_divide
from .preprocess import interpolate_window, moving_average, require_columns

REC = ("recording",)


def variants_of(traces: DataFrame, smooth: int = 5) -> DataFrame:
    """raw, a centered moving average and a gain-and-offset copy of a panel, stacked."""
    smoothed = moving_average(traces, "value", smooth, ["recording", "neuron"], "time_index")
    gain = traces.withColumn("value", F.col("value") * 0.9 + F.col("neuron") * 0.01)
    named = [d.select("recording", F.lit(n).alias("variant"), "time_index", "neuron", "value") for n, d in (("raw", traces), ("smooth", smoothed), ("gain", gain))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def against(variants: DataFrame, reference: str = "raw", keys: Sequence[str] = REC) -> DataFrame:
    """Each value with the reference's value of the same place, as `raw`."""
    ref = variants.filter(F.col("variant") == reference).select(*keys, "time_index", "neuron", F.col("value").alias("raw"))
    return variants.join(ref, [*keys, "time_index", "neuron"])


def wide_against(variants: DataFrame, reference: str = "raw", keys: Sequence[str] = REC) -> DataFrame:
    """Wide frames (keys, variant, time_index, x) with the reference's vector of the same time, as `raw`."""
    ref = variants.filter(F.col("variant") == reference).select(*keys, "time_index", F.col("x").alias("raw"))
    return variants.join(ref, [*keys, "time_index"])


def long_pairs(pairs: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """The rows of against(), from those of wide_against() without a shuffle."""
    both = pairs.withColumn("_n", F.least(F.size("x"), F.size("raw"))).filter("_n > 0")
    cells = F.posexplode(F.arrays_zip(F.slice("x", F.lit(1), F.col("_n")).alias("value"), F.slice("raw", F.lit(1), F.col("_n")).alias("raw"))).alias("neuron", "_p")
    return both.select(*keys, "variant", "time_index", cells).select(*keys, "time_index", "neuron", "variant", F.col("_p.value").alias("value"), F.col("_p.raw").alias("raw"))


def neuron_preservation(paired: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    v, r = F.col("value"), F.col("raw")
    rows = paired.groupBy(*keys, "variant", "neuron").agg(
        pearson(v, r).alias("pearson"), rmse(v, r).alias("rmse"), F.stddev_pop(r).alias("raw_std"), F.avg(F.abs(v - r)).alias("mean_abs_delta"), safe_divide(F.var_pop(v), F.var_pop(r)).alias("variance_ratio")
    )
    return rows.withColumn("nrmse", safe_divide("rmse", "raw_std"))


def trace_preservation(paired: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """One row for each variant: global correlation and the spread of per-neuron figures."""
    per = neuron_preservation(paired, keys)
    q = lambda c, at: quantile(c, at)
    summary = per.groupBy(*keys, "variant").agg(
        F.avg("pearson").alias("pearson_mean"), median("pearson").alias("pearson_median"), q("pearson", 0.25).alias("pearson_q25"), q("pearson", 0.75).alias("pearson_q75"),
        F.avg("rmse").alias("rmse_mean"), F.avg("nrmse").alias("nrmse_mean"), F.avg("mean_abs_delta").alias("mean_abs_delta"),
        median("variance_ratio").alias("variance_ratio_median"), q("variance_ratio", 0.25).alias("variance_ratio_q25"), q("variance_ratio", 0.75).alias("variance_ratio_q75"),
    )
    whole = paired.groupBy(*keys, "variant").agg(pearson("value", "raw").alias("global_pearson"))
    return summary.join(whole, [*keys, "variant"])


def retained_energy(paired: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Share of the reference's energy about its neurons' means that a variant holds."""
    per = paired.groupBy(*keys, "variant", "neuron").agg((F.var_pop("value") * F.count(F.lit(1))).alias("e"), (F.var_pop("raw") * F.count(F.lit(1))).alias("r"))
    return per.groupBy(*keys, "variant").agg(safe_divide(F.sum("e"), F.sum("r")).alias("retained_energy"))


def spectral_preservation(spectra: DataFrame, rate: float, fmin: float, fmax: float, reference: str = "raw", keys: Sequence[str] = REC) -> DataFrame:
    """Each variant's power, of all neurons of spectra(keys, variant, neuron, power), as a share of the reference's; the share of it from
    fmin to fmax, and that share's change from the reference's. NULL where there is no power, the shares also without a bin in the band.
    """
    bins = spectra.select(*keys, "variant", (F.size("power") - 1).alias("_last"), F.posexplode("power").alias("_bin", "_p"))
    low = F.sum(F.when((F.col("_bin") * (rate / 2) / F.col("_last")).between(fmin, fmax), F.col("_p")))
    sums = bins.groupBy(*keys, "variant").agg(F.sum("_p").alias("_total"), low.alias("_low")).withColumn("low_frequency_power_fraction", positive_ratio("_low", "_total"))
    ref = sums.filter(F.col("variant") == reference).select(*keys, F.col("_total").alias("_ref_total"), F.col("low_frequency_power_fraction").alias("_ref_low"))
    return sums.join(ref, list(keys)).select(
        *keys, "variant", positive_ratio("_total", "_ref_total").alias("spectral_power_retention"), "low_frequency_power_fraction",
        (F.col("low_frequency_power_fraction") - F.col("_ref_low")).alias("low_frequency_power_fraction_delta"),
        F.lit(float(fmin)).alias("low_frequency_fmin_hz"), F.lit(float(fmax)).alias("low_frequency_fmax_hz"),
    )


def lag_autocorrelation(variants: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("recording", "variant")) -> DataFrame:
    """Mean product of z-scored values `lag` frames apart, of each neuron."""
    series = Window.partitionBy(*keys, "neuron")
    std = F.stddev_pop("value").over(series)
    z = variants.withColumn("_z", (F.col("value") - F.avg("value").over(series)) / F.when(std > 0, std).otherwise(1.0))
    order = series.orderBy("time_index")
    parts = z.select(*keys, "neuron", F.col("_z"), *(F.lag("_z", k).over(order).alias(f"_lag{k}") for k in lags))
    return parts.groupBy(*keys, "neuron").agg(*(F.avg(F.col("_z") * F.col(f"_lag{k}")).alias(f"acf_{k}") for k in lags))


def autocorrelation_change(variants: DataFrame, lags: Sequence[int], reference: str = "raw", keys: Sequence[str] = REC) -> DataFrame:
    """Median over neurons of the absolute change of each lag's autocorrelation from the reference's."""
    acf = lag_autocorrelation(variants, lags, [*keys, "variant"]).unpivot([*keys, "variant", "neuron"], [f"acf_{k}" for k in lags], "lag", "acf")
    ref = acf.filter(F.col("variant") == reference).select(*keys, "neuron", "lag", F.col("acf").alias("_ref"))
    met = acf.join(ref, [*keys, "neuron", "lag"]).withColumn("lag", F.regexp_extract("lag", r"(\d+)", 1).cast("int"))
    return met.groupBy(*keys, "variant", "lag").agg(median(F.abs(F.col("acf") - F.col("_ref"))).alias("acf_change_median"))


def regression_metrics(rows: DataFrame, y: str, predicted: str, keys: Sequence[str]) -> DataFrame:
    """r2, pearson, spearman, rmse and nrmse (by the target's population deviation)."""
    ranked = rows.withColumns({"_ry": average_rank_by(y, keys), "_rp": average_rank_by(predicted, keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r_squared(y, predicted).alias("r2"), pearson(y, predicted).alias("pearson"), pearson("_ry", "_rp").alias("spearman"), rmse(y, predicted).alias("rmse"), F.stddev_pop(y).alias("_std"))
    return out.withColumn("nrmse", safe_divide("rmse", "_std")).drop("_std")


def percent_rank_average(c: str, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
    return ((F.rank().over(w.orderBy(c)) + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(w)).cast("double")


def classification_metrics(rows: DataFrame, y: str, predicted: str, keys: Sequence[str], score: str | None = None) -> DataFrame:
    """Balanced accuracy, macro F1 and ROC AUC of 0/1 labels; NULL where the truth has one class only."""
    own = rows.withColumn("_rank", average_rank_by(score, keys)) if score else rows.withColumn("_rank", F.lit(None).cast("double"))
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(predicted) == b))
    c = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(1, 0).alias("fn"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), F.sum(F.when(F.col(y) == 1, F.col("_rank"))).alias("_ranks"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    both = (pos > 0) & (neg > 0)
    f1 = lambda t, a, b: F.coalesce(safe_divide(2.0 * t, 2 * t + a + b), F.lit(0.0))
    return c.select(
        *keys, "n",
        F.when(both, (F.col("tp") / pos + F.col("tn") / neg) / 2).alias("balanced_accuracy"),
        F.when(both, (f1(F.col("tp"), F.col("fp"), F.col("fn")) + f1(F.col("tn"), F.col("fp"), F.col("fn"))) / 2).alias("macro_f1"),
        F.when(both, (F.col("_ranks") - pos * (pos + 1) / 2.0) / (pos * neg)).alias("roc_auc"),
    )


def average_rank_by(c: str, keys: Sequence[str]) -> Column:
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
    return (F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (ties - 1) / F.lit(2.0)).cast("double")


def summarize_metrics(metrics: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over folds; null ids are kept as groups, NaN values skipped."""
    clean = {v: F.nanvl(F.col(v).cast("double"), F.lit(None)) for v in values}
    return metrics.groupBy(*ids).agg(*(f for v in values for f in (F.avg(clean[v]).alias(f"{v}_mean"), F.stddev_samp(clean[v]).alias(f"{v}_std"))))


def tidy_summary(summary: DataFrame, ids: Sequence[str], lower_is_better: Sequence[str] = ("rmse", "nrmse")) -> DataFrame:
    """*_mean and *_std columns as rows (metric, mean, std, higher_is_better)."""
    names = [c.removesuffix("_mean") for c in summary.columns if c.endswith("_mean")]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")) for n in names)))
    return summary.select(*ids, pairs.alias("_p")).select(*ids, "_p.metric", "_p.mean", "_p.std", (~F.col("_p.metric").isin(*lower_is_better)).alias("higher_is_better"))


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that raises if a key repeats on either side."""
    for name, side in (("left", left), ("right", right)):
        if rows := side.groupBy(*on).count().filter("count > 1").limit(3).collect():
            raise ValueError(f"keys repeat on the {name} side: {rows}")
    return left.join(right, list(on), how)


def paired_with_reference(predictions: DataFrame, reference: str, keys: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """Predictions beside the reference method's for the same key; null context values match each other."""
    require_columns(predictions, [*keys, *context, "method", "y_true", "y_pred"])
    ref = predictions.filter(F.col("method") == reference).select(*(F.col(k).alias(f"_{k}") for k in (*keys, *context)), F.col("y_pred").alias("y_ref"))
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    for k in context:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return predictions.filter(F.col("method") != reference).join(ref, match).drop(*(f"_{k}" for k in (*keys, *context)))


def recording_effects(results: DataFrame, value: str, reference: str, unit: str = "recording", method: str = "method") -> DataFrame:
    """Paired differences to the reference method over units: count, quartiles, extremes, positives, and exact sign-flip p, NULL for methods of
    more than MOST_UNITS units.
    """
    from .inference import MOST_UNITS, exact_sign_flip

    wide = results.groupBy(unit, method).agg(F.avg(value).alias("_v"))
    ref = wide.filter(F.col(method) == reference).select(unit, F.col("_v").alias("_r"))
    d = wide.filter(F.col(method) != reference).join(ref, unit).withColumn("difference", F.col("_v") - F.col("_r")).filter(F.col("difference").isNotNull())
    out = d.groupBy(method).agg(
        F.count(F.lit(1)).alias("n_units"), median("difference").alias("median_difference"), quantile("difference", 0.25).alias("q25"), quantile("difference", 0.75).alias("q75"),
        F.min("difference").alias("min_difference"), F.max("difference").alias("max_difference"), F.count_if(F.col("difference") > 0).alias("n_positive"),
    )
    few = d.join(out.filter(F.col("n_units") <= MOST_UNITS).select(method), method, "left_semi")
    return out.join(exact_sign_flip(few, "difference", [method]), method, "left")


def bpi_ablation(scores: DataFrame, epsilon: float = 1e-9, weights: dict[str, float] | None = None) -> DataFrame:
    """Preservation index 100 * (score - null) / (raw - null) of scores(recording, method, component, scope, score, raw_score, null_score),
    under three normalizations, combined and by scope, with equal weights and with `weights` of the components.
    """
    require_columns(scores, ["recording", "method", "component", "scope", "score", "raw_score", "null_score"])
    s, raw, null = F.col("score"), F.col("raw_score"), F.col("null_score")
    ratio = lambda a, b: F.when(F.abs(b) > epsilon, 100.0 * a / b)
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("normalization"), v.alias("index")) for n, v in (("raw_null", ratio(s - null, raw - null)), ("raw_only", ratio(s, raw)), ("none", 100.0 * s)))))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("component") == name, w).otherwise(weight)
    long = scores.select("recording", "method", "component", "scope", kinds.alias("_k"), weight.alias("_w")).select("recording", "method", "scope", "_k.normalization", F.col("_k.index").alias("_i"), "_w").filter(F.col("_i").isNotNull())
    schemes = F.explode(F.array(F.struct(F.lit("equal").alias("weighting"), F.lit(1.0).alias("w")), F.struct(F.lit("custom").alias("weighting"), F.col("_w").alias("w"))))
    long = long.withColumn("_s", schemes).select("recording", "method", "scope", "normalization", "_i", "_s.weighting", "_s.w")
    sets = long.groupingSets([["recording", "method", "normalization", "weighting"], ["recording", "method", "normalization", "weighting", "scope"]], "recording", "method", "normalization", "weighting", "scope")
    out = sets.agg(safe_divide(F.sum(F.col("_i") * F.col("w")), F.sum("w")).alias("bpi"), F.count(F.lit(1)).alias("n_components"))
    return out.select("recording", "method", F.coalesce("scope", F.lit("combined")).alias("scope"), "normalization", "weighting", "bpi", "n_components")


def labelled_scorecard(card: DataFrame, reference: str, value: str = "preservation", method: str = "method", keys: Sequence[str] = REC) -> DataFrame:
    """A recommendation for each method by its preservation (percent), best first; the reference leads."""
    order = Window.partitionBy(*keys).orderBy(F.col("_ref"), F.col(value).desc_nulls_last(), F.col(method))
    own = card.withColumn("_ref", F.when(F.col(method) == reference, 0).otherwise(1)).withColumn("place", F.row_number().over(order).cast("int"))
    best = F.min(F.when((F.col("_ref") == 1) & F.col(value).isNotNull(), F.col("place"))).over(Window.partitionBy(*keys))
    v = F.col(value)
    label = (
        F.when(F.col("_ref") == 0, "raw reference").when(v.isNull(), "insufficient data").when(F.col("place") == best, "best preserved")
        .when(v >= 80, "acceptable").when(v >= 50, "information-loss risk").otherwise("not recommended")
    )
    return own.withColumn("recommendation", label).drop("_ref")


def artifact_distortion(paired: DataFrame, centers: DataFrame, half_width: int, guard: int, keys: Sequence[str] = REC) -> DataFrame:
    """Mean absolute change from raw within half_width of each center and between there and the guard, of each neuron."""
    t = F.abs(F.col("time_index") - F.col("center"))
    met = paired.join(centers, list(keys)).withColumn("_d", F.abs(F.col("value") - F.col("raw")))
    return met.groupBy(*keys, "variant", "center", "neuron").agg(F.avg(F.when(t <= half_width, F.col("_d"))).alias("near"), F.avg(F.when(t > guard, F.col("_d"))).alias("far")).withColumn("near_far_ratio", safe_divide("near", "far"))


def pseudo_artifact_error(paired: DataFrame, centers: DataFrame, half_width: int, reference: str = "raw", keys: Sequence[str] = REC) -> DataFrame:
    """RMSE to the reference over all neurons within half_width of each center(keys, center), of each variant and of `interpolation`, a line through
    the frames just outside; that has no row for a center without both of them.
    """
    near = paired.join(centers, list(keys)).filter(F.abs(F.col("time_index") - F.col("center")) <= half_width).select(*keys, "center", "variant", "value", "raw")
    own = paired.filter(F.col("variant") == reference).select(*keys, "time_index", "neuron", F.col("raw").alias("value"))
    line = interpolate_window(own, centers, half_width, keys).filter("interpolated IS NOT NULL")
    rows = near.unionByName(line.select(*keys, "center", F.lit("interpolation").alias("variant"), F.col("interpolated").alias("value"), F.col("value").alias("raw")))
    return rows.groupBy(*keys, "center", "variant").agg(rmse("raw", "value").alias("rmse"))


def representative_neurons(paired: DataFrame, n: int = 12, reference: str = "raw", keys: Sequence[str] = REC) -> DataFrame:
    """The n neurons of each recording with the largest z(reference deviation) + z(mean absolute change); ties to the smaller number."""
    per = paired.groupBy(*keys, "neuron").agg(F.stddev_pop(F.when(F.col("variant") == reference, F.col("raw"))).alias("_s"), F.avg(F.when(F.col("variant") != reference, F.abs(F.col("value") - F.col("raw")))).alias("_d"))
    w = Window.partitionBy(*keys)
    z = lambda c: F.coalesce(safe_divide(F.col(c) - F.avg(c).over(w), F.when(F.stddev_pop(c).over(w) > 0, F.stddev_pop(c).over(w))), F.lit(0.0))
    ranked = per.withColumn("score", z("_s") + z("_d"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "neuron")
    return ranked.withColumn("place", F.row_number().over(order).cast("int")).filter(F.col("place") <= n).select(*keys, "neuron", "place", "score")


def pivot_scorecard(tidy: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One column for each metric of `names`, its first value."""
    return tidy.groupBy(*keys).pivot("metric", list(names)).agg(F.first("mean"))


def latent_behavior_correlation(embeddings: DataFrame, lag: int, keys: Sequence[str], z: str = "z", y: str = "y", time: str = "time_index") -> DataFrame:
    """Correlation of each latent coordinate with the target `lag` rows later, within each key."""
    w = Window.partitionBy(*keys).orderBy(time)
    ahead = embeddings.withColumn("_y", F.lead(y, lag).over(w) if lag else F.col(y)).filter(F.col("_y").isNotNull())
    long = ahead.select(*keys, "_y", F.posexplode(z).alias("latent", "_z"))
    return long.groupBy(*keys, "latent").agg(pearson("_z", "_y").alias("correlation"), F.count(F.lit(1)).alias("n"))
