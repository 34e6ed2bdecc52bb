"""Queries over decoding, latent-state models and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import rmse, rounded as r6
from ..operators import bss, decoding, folds, metrics, ridge
from ..pipeline.evaluation import EvaluationConfig, LatentConfig, run_evaluation
from ..scratch import saved
from ..sources.panels import frames, traces, wide_form
from .components import welch_sql
from .metrics import VARIANTS, _rounded
from .preprocess import LONG, WIDE


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw and a causal moving average of each neuron."""
    wide = frames(spark, sf_dir).select("recording", "time_index", "x")
    before = F.lag("x", 1).over(Window.partitionBy("recording").orderBy("time_index"))
    smooth = wide.withColumn("x", F.zip_with("x", F.coalesce(before, F.col("x")), lambda a, b: (a + b) / 2))
    return wide.withColumn("variant", F.lit("raw")).unionByName(smooth.withColumn("variant", F.lit("smooth")))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("recording", "time_index", F.col("level").alias("angle"), F.abs(F.col("x")[0]).alias("vigor"))


def decoding_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir).withColumn("y", F.col("angle"))
    p = decoding.run_decoding(_variants(spark, sf_dir), t, "regression", 4, 6, nulls=[("block_shuffle", 0), ("circular_shift", 1)])
    return _rounded(decoding.decoding_metrics(saved(p, "predictions"), "regression"), *(c for c in decoding.JOB))


def decoding_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir).withColumn("y", F.col("vigor"))
    p = decoding.run_decoding(_variants(spark, sf_dir), t, "classification", 4, 6)
    return _rounded(decoding.decoding_metrics(saved(p, "predictions"), "classification"), *(c for c in decoding.JOB))


def latent_state_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(decoding.latent_states(_variants(spark, sf_dir), _targets(spark, sf_dir), 5, 3, 1, 4, 6, transitions=("linear", "mlp")), "latent")
    return _rounded(decoding.latent_metrics(rows).join(decoding.markov_sufficiency(rows), list(decoding.CAUSAL)), *decoding.CAUSAL)


def decoding_one_neuron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding of the level from the first neuron of raw and smoothed frames, within and between them, which has a closed form."""
    one = _variants(spark, sf_dir).withColumn("x", F.slice("x", 1, 1))
    t = frames(spark, sf_dir).select("recording", "time_index", F.col("level").alias("y"))
    p = decoding.run_decoding(one, t, "regression", 4, 6, lags=(0,))
    own = p.groupBy("recording", "comparison", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("n_train").alias("n_train"), F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
    return _rounded(own.join(decoding.decoding_metrics(p, "regression").filter("test_version = 'smooth' OR comparison = 'transfer_clean_to_raw'").select("recording", "comparison", "fold", "rmse", "r2"), ["recording", "comparison", "fold"]), "recording", "comparison", "fold")


ONE_NEURON = f"""WITH {WIDE}, e AS (SELECT recording, fold, CAST(round_even(fold * n / 4.0, 0) AS INTEGER) AS start, CAST(round_even((fold + 1) * n / 4.0, 0) AS INTEGER) AS stop FROM (SELECT recording, max(time_index) + 1 AS n FROM wide GROUP BY 1), (SELECT CAST(unnest(range(4)) AS INTEGER) AS fold)),
b AS (SELECT recording, time_index, level AS y, x[1] AS raw, (x[1] + coalesce(lag(x[1]) OVER (PARTITION BY recording ORDER BY time_index), x[1])) / 2 AS smooth FROM wide),
v AS (SELECT recording, time_index, y, 'within' AS comparison, 'raw' AS test_version, raw AS a, raw AS b FROM b UNION ALL SELECT recording, time_index, y, 'within', 'smooth', smooth, smooth FROM b
 UNION ALL SELECT recording, time_index, y, 'transfer_raw_to_clean', 'smooth', raw, smooth FROM b UNION ALL SELECT recording, time_index, y, 'transfer_clean_to_raw', 'raw', smooth, raw FROM b),
m AS (SELECT recording, comparison, test_version, fold, count(*) AS n_train, avg(a) AS ma, avg(y) AS my, covar_pop(a, y) / var_pop(a) * count(*) / (count(*) + 10.0) AS slope FROM v JOIN e USING (recording) WHERE time_index < start - 6 OR time_index >= stop + 6 GROUP BY 1, 2, 3, 4),
p AS (SELECT recording, comparison, test_version, fold, n_train, y, my + slope * (b - ma) AS f FROM v JOIN e USING (recording) JOIN m USING (recording, comparison, test_version, fold) WHERE time_index >= start AND time_index < stop),
k AS (SELECT recording, comparison, fold, count(*) AS n, min(n_train) AS n_train, avg(y) AS y_true, avg(f) AS y_pred FROM p GROUP BY 1, 2, 3),
s AS (SELECT recording, comparison, fold, sqrt(avg((y - f) * (y - f))) AS rmse, 1 - sum((y - f) * (y - f)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM p WHERE test_version = 'smooth' OR comparison = 'transfer_clean_to_raw' GROUP BY 1, 2, 3)
SELECT recording, comparison, fold, n, n_train, round(y_true, 6) + 0.0 AS y_true, round(y_pred, 6) + 0.0 AS y_pred, round(rmse, 6) + 0.0 AS rmse, round(r2, 6) + 0.0 AS r2 FROM k JOIN s USING (recording, comparison, fold)"""


def decoding_two_neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge decoding of the level from the first two neurons by sums over chunks of 40 frames, within variants and between them."""
    two = _variants(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    edges = folds.fold_edges(two.filter("variant = 'raw'"), 4, 6)
    t = frames(spark, sf_dir).select("recording", "time_index", F.col("level").alias("y"))
    p = ridge.ridge_by_folds(two, t, edges, ["y"], lags=(0,), chunk=40)
    keys = ["recording", "comparison", "train_version", "test_version", "fold"]
    return _rounded(p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("n_train").alias("n_train"), rmse("y_true", "y_pred").alias("rmse"), F.max("y_pred").alias("highest")), *keys)


#: Two standardized features: the normal equations' 2 x 2 system in closed form.
TWO_NEURONS = f"""WITH {WIDE},
e AS (SELECT recording, fold, CAST(round_even(fold * n / 4.0, 0) AS INTEGER) AS start, CAST(round_even((fold + 1) * n / 4.0, 0) AS INTEGER) AS stop FROM (SELECT recording, max(time_index) + 1 AS n FROM wide GROUP BY 1), (SELECT CAST(unnest(range(4)) AS INTEGER) AS fold)),
b AS (
 SELECT recording, time_index, level AS y, x[1] AS r1, x[2] AS r2, (x[1] + coalesce(lag(x[1]) OVER w, x[1])) / 2 AS s1, (x[2] + coalesce(lag(x[2]) OVER w, x[2])) / 2 AS s2
 FROM wide WINDOW w AS (PARTITION BY recording ORDER BY time_index)),
v AS (
 SELECT *, 'within' AS comparison, 'raw' AS train_version, 'raw' AS test_version, r1 AS a1, r2 AS a2, r1 AS b1, r2 AS b2 FROM b
 UNION ALL SELECT *, 'within', 'smooth', 'smooth', s1, s2, s1, s2 FROM b
 UNION ALL SELECT *, 'transfer_raw_to_clean', 'raw', 'smooth', r1, r2, s1, s2 FROM b
 UNION ALL SELECT *, 'transfer_clean_to_raw', 'smooth', 'raw', s1, s2, r1, r2 FROM b),
m AS (
 SELECT recording, comparison, train_version, test_version, fold, count(*) AS n, avg(a1) AS m1, avg(a2) AS m2, stddev_pop(a1) AS d1, stddev_pop(a2) AS d2, avg(y) AS my,
  covar_pop(a1, a2) / (stddev_pop(a1) * stddev_pop(a2)) * count(*) AS c12, covar_pop(a1, y) / stddev_pop(a1) * count(*) AS c1, covar_pop(a2, y) / stddev_pop(a2) * count(*) AS c2
 FROM v JOIN e USING (recording) WHERE time_index < start - 6 OR time_index >= stop + 6 GROUP BY ALL),
w AS (SELECT *, ((n + 10) * c1 - c12 * c2) / ((n + 10) ** 2 - c12 ** 2) AS w1, ((n + 10) * c2 - c12 * c1) / ((n + 10) ** 2 - c12 ** 2) AS w2 FROM m),
p AS (
 SELECT recording, comparison, train_version, test_version, fold, w.n, y, my + w1 * (b1 - m1) / d1 + w2 * (b2 - m2) / d2 AS f
 FROM v JOIN e USING (recording) JOIN w USING (recording, comparison, train_version, test_version, fold) WHERE time_index >= start AND time_index < stop)
SELECT recording, comparison, train_version, test_version, fold, count(*) AS n, min(p.n) AS n_train, round(sqrt(avg((y - f) ** 2)), 6) + 0.0 AS rmse, round(max(f), 6) + 0.0 AS highest
FROM p GROUP BY 1, 2, 3, 4, 5"""


def ridge_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("recording", "neuron").orderBy("time_index")
    rows = traces(spark, sf_dir).withColumn("next", F.lead("value", 1).over(w)).filter(F.col("next").isNotNull())
    return _rounded(decoding.ridge_from_sums(rows, "value", "next", 10.0, ["recording", "neuron"]), "recording", "neuron")


RIDGE = f"""WITH {LONG}, d AS (SELECT *, lead(value, 1) OVER (PARTITION BY recording, neuron ORDER BY time_index) AS nxt FROM traces), s AS (SELECT recording, neuron, covar_pop(value, nxt) * count(*) / (var_pop(value) * count(*) + 10.0) AS slope, avg(nxt) AS my, avg(value) AS mx, count(*) AS n FROM d WHERE nxt IS NOT NULL GROUP BY 1, 2)
SELECT recording, neuron, round(slope, 6) + 0.0 AS slope, round(my - slope * mx, 6) + 0.0 AS intercept, n FROM s"""


def spectral_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out power of raw, smoothed and scaled traces: retention and low-band share of each fold."""
    wide = wide_form(metrics.variants_of(traces(spark, sf_dir)), ("recording", "variant", "time_index"))
    roles = folds.strict_folds(frames(spark, sf_dir), 2, 6).filter("role = 'test'").select("recording", "fold", "time_index")
    spectra = bss.panel_spectra(wide.join(roles, ["recording", "time_index"]), 4.0, 64, 32, ["recording", "fold", "variant"])
    return _rounded(metrics.spectral_preservation(saved(spectra, "spectra"), 4.0, 0.0, 0.2, keys=["recording", "fold"]), "recording", "fold", "variant")


PRESERVED = f"""WITH {VARIANTS},
sizes AS (SELECT recording, max(time_index) + 1 AS n FROM wide GROUP BY 1),
edges AS (SELECT recording, fold, round_even(fold * n / 2.0, 0) AS start, round_even((fold + 1) * n / 2.0, 0) AS stop FROM sizes, (SELECT CAST(unnest(range(2)) AS INTEGER) AS fold)),
held AS (SELECT recording, fold, variant, neuron, time_index, value FROM variants JOIN edges USING (recording) WHERE time_index >= start AND time_index < stop),
{welch_sql("held", "recording, fold, variant, neuron", 4.0, 64, 32)},
t AS (SELECT recording, fold, variant, sum(power) AS total, sum(power) FILTER (bin * 2.0::DOUBLE / last BETWEEN 0 AND 0.2) / sum(power) AS low FROM (SELECT *, max(bin) OVER (PARTITION BY recording, fold, variant) AS last FROM spectra) GROUP BY 1, 2, 3)
SELECT t.recording, t.fold, t.variant, round(t.total / r.total, 6) + 0.0 AS spectral_power_retention, round(t.low, 6) + 0.0 AS low_frequency_power_fraction,
 round(t.low - r.low, 6) + 0.0 AS low_frequency_power_fraction_delta, 0.0 AS low_frequency_fmin_hz, 0.2 AS low_frequency_fmax_hz
FROM t JOIN t r ON r.recording = t.recording AND r.fold = t.fold AND r.variant = 'raw'"""


def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small configuration end to end; the trace table of all folds and variants with the decoding of vigor beside it."""
    config = EvaluationConfig(
        n_splits=2, gap=6, bss_methods=("fastica",), n_components=6, n_clusters=3, keep_cluster_counts=(1,), selection_strategies=("low_frequency", "all"), baseline_ranks=(6,), lowpass_cutoffs_hz=(0.4,),
        ic_quality_selection_strategies=("ic_quality_nonartifact",), uncertainty_n_bootstrap=200, uncertainty_n_permutations=200, latent=LatentConfig(window=4, target_shifts=(1,), ridge_alpha=10.0), bss_max_iter=100, feature_start_bin=0, welch_nperseg=64, welch_noverlap=32,
    )
    tables = run_evaluation(frames(spark, sf_dir), _targets(spark, sf_dir), config)
    vigor = tables["behavior_vigor"].filter("comparison = 'within'").select(F.split("recording", "#")[0].cast("int").alias("recording"), "fold", F.col("test_version").alias("variant"), r6("rmse").alias("vigor_rmse"))
    return _rounded(tables["trace_metrics"], "recording", "fold", "variant").join(vigor, ["recording", "fold", "variant"])


QUERIES = {"decoding_one_neuron": decoding_one_neuron, "decoding_two_neurons": decoding_two_neurons, "decoding_regression": decoding_regression, "decoding_classification": decoding_classification, "latent_state_metrics": latent_state_metrics, "ridge_one_feature": ridge_one_feature, "spectral_preservation": spectral_preservation, "full_evaluation": full_evaluation}
ORACLES = {"ridge_one_feature": RIDGE, "decoding_one_neuron": ONE_NEURON, "decoding_two_neurons": TWO_NEURONS, "spectral_preservation": PRESERVED}
