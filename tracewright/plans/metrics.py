"""Queries over metric, effect and inference operators, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded as r6
from ..operators import inference, metrics as m, setops
from ..sources.panels import frames, table, traces
from .preprocess import LONG, WIDE, moving_average_sql

VARIANTS = f"""{LONG}, variants AS (SELECT recording, 'raw' AS variant, time_index, neuron, value FROM traces
UNION ALL SELECT recording, 'smooth', time_index, neuron, smooth FROM ({moving_average_sql("traces", "value", 5, "recording, neuron", "time_index")})
UNION ALL SELECT recording, 'gain', time_index, neuron, value * 0.9 + neuron * 0.01 FROM traces),
paired AS (SELECT v.*, t.value AS raw FROM variants v JOIN traces t USING (recording, time_index, neuron)),
per AS (SELECT recording, variant, neuron, covar_pop(value, raw) / nullif(stddev_pop(value) * stddev_pop(raw), 0) AS pearson, sqrt(avg((value - raw) * (value - raw))) AS rmse, stddev_pop(raw) AS raw_std,
 avg(abs(value - raw)) AS mean_abs_delta, var_pop(value) / nullif(var_pop(raw), 0) AS variance_ratio FROM paired GROUP BY 1, 2, 3)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.against(m.variants_of(traces(spark, sf_dir)))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


def trace_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.trace_preservation(_paired(spark, sf_dir)), "recording", "variant")


TRACE = f"""WITH {VARIANTS}, g AS (SELECT recording, variant, covar_pop(value, raw) / nullif(stddev_pop(value) * stddev_pop(raw), 0) AS global_pearson FROM paired GROUP BY 1, 2),
s AS (SELECT recording, variant, avg(pearson) AS pearson_mean, median(pearson) AS pearson_median, quantile_cont(pearson, 0.25) AS pearson_q25, quantile_cont(pearson, 0.75) AS pearson_q75, avg(rmse) AS rmse_mean,
 avg(rmse / nullif(raw_std, 0)) AS nrmse_mean, avg(mean_abs_delta) AS mean_abs_delta, median(variance_ratio) AS variance_ratio_median, quantile_cont(variance_ratio, 0.25) AS variance_ratio_q25, quantile_cont(variance_ratio, 0.75) AS variance_ratio_q75 FROM per GROUP BY 1, 2)
SELECT recording, variant, round(COLUMNS(* EXCLUDE (recording, variant)), 6) + 0.0 FROM s JOIN g USING (recording, variant)"""


def neuron_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.neuron_preservation(_paired(spark, sf_dir)), "recording", "variant", "neuron")


NEURONS = f"WITH {VARIANTS} SELECT recording, variant, neuron, round(COLUMNS(* EXCLUDE (recording, variant, neuron)), 6) + 0.0 FROM (SELECT *, rmse / nullif(raw_std, 0) AS nrmse FROM per)"


def retained_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.retained_energy(_paired(spark, sf_dir)), "recording", "variant")


ENERGY = f"WITH {VARIANTS}, e AS (SELECT recording, variant, neuron, var_pop(value) * count(*) AS e, var_pop(raw) * count(*) AS r FROM paired GROUP BY 1, 2, 3) SELECT recording, variant, round(sum(e) / sum(r), 6) + 0.0 AS retained_energy FROM e GROUP BY 1, 2"


def autocorrelation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.autocorrelation_change(m.variants_of(traces(spark, sf_dir)), (1, 3, 5)), "recording", "variant", "lag")


ACF = f"""WITH {VARIANTS}, z AS (SELECT recording, variant, neuron, time_index, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END AS z FROM variants WINDOW w AS (PARTITION BY recording, variant, neuron)),
a AS (SELECT x.recording, x.variant, x.neuron, k AS lag, avg(x.z * y.z) AS acf FROM z x, (VALUES (1), (3), (5)) l(k), z y WHERE y.recording = x.recording AND y.variant = x.variant AND y.neuron = x.neuron AND y.time_index = x.time_index - k GROUP BY 1, 2, 3, 4)
SELECT a.recording, a.variant, a.lag, round(median(abs(a.acf - r.acf)), 6) + 0.0 AS acf_change_median FROM a JOIN a r ON r.recording = a.recording AND r.neuron = a.neuron AND r.lag = a.lag AND r.variant = 'raw' GROUP BY 1, 2, 3"""


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir).filter("variant = 'smooth'")
    return _rounded(m.regression_metrics(rows, "raw", "value", ["recording", "neuron"]), "recording", "neuron")


REGRESSION = f"""WITH {VARIANTS}, k AS (SELECT recording, neuron, raw AS y, value AS p, rank() OVER (PARTITION BY recording, neuron ORDER BY raw) + (count(*) OVER (PARTITION BY recording, neuron, raw) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY recording, neuron ORDER BY value) + (count(*) OVER (PARTITION BY recording, neuron, value) - 1) / 2.0 AS rp FROM paired WHERE variant = 'smooth')
SELECT recording, neuron, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2, round(covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)), 6) + 0.0 AS pearson,
 round(covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)), 6) + 0.0 AS spearman, round(sqrt(avg((y - p) * (y - p))), 6) + 0.0 AS rmse, round(sqrt(avg((y - p) * (y - p))) / stddev_pop(y), 6) + 0.0 AS nrmse FROM k GROUP BY 1, 2"""


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("recording", "bout_state", F.round(F.col("x")[0], 1).alias("score")).withColumn("predicted", (F.col("score") > 0).cast("int"))
    return _rounded(m.classification_metrics(rows, "bout_state", "predicted", ["recording"], "score"), "recording")


CLASSIFICATION = f"""WITH {WIDE}, s AS (SELECT recording, bout_state AS y, round(x[1], 1) AS score FROM wide),
k AS (SELECT *, CAST(score > 0 AS INTEGER) AS p, rank() OVER (PARTITION BY recording ORDER BY score) + (count(*) OVER (PARTITION BY recording, score) - 1) / 2.0 AS r FROM s),
c AS (SELECT recording, count(*) AS n, count_if(y = 1 AND p = 1) AS tp, count_if(y = 1 AND p = 0) AS fn, count_if(y = 0 AND p = 1) AS fp, count_if(y = 0 AND p = 0) AS tn, sum(CASE WHEN y = 1 THEN r END) AS ranks FROM k GROUP BY 1)
SELECT recording, n, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) + 0.0 AS balanced_accuracy, round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 6) + 0.0 AS macro_f1,
 round((ranks - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn) * (tn + fp)), 6) + 0.0 AS roc_auc FROM c"""


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.summarize_metrics(m.neuron_preservation(_paired(spark, sf_dir)), ["variant"], ["pearson", "rmse", "nrmse"]), "variant")


_SUMMARY = f"s AS (SELECT variant, avg(pearson) AS pearson_mean, stddev_samp(pearson) AS pearson_std, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(rmse / raw_std) AS nrmse_mean, stddev_samp(rmse / raw_std) AS nrmse_std FROM per GROUP BY 1)"
SUMMARY = f"WITH {VARIANTS}, {_SUMMARY} SELECT variant, round(COLUMNS(* EXCLUDE variant), 6) + 0.0 FROM s"


def tidy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.summarize_metrics(m.neuron_preservation(_paired(spark, sf_dir)), ["variant"], ["pearson", "rmse", "nrmse"])
    return _rounded(m.tidy_summary(s, ["variant"]), "variant", "metric")


TIDY = f"""WITH {VARIANTS}, {_SUMMARY} SELECT variant, 'pearson' AS metric, round(pearson_mean, 6) + 0.0 AS mean, round(pearson_std, 6) + 0.0 AS std, true AS higher_is_better FROM s
UNION ALL SELECT variant, 'rmse', round(rmse_mean, 6) + 0.0, round(rmse_std, 6) + 0.0, false FROM s UNION ALL SELECT variant, 'nrmse', round(nrmse_mean, 6) + 0.0, round(nrmse_std, 6) + 0.0, false FROM s"""


def scorecard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.summarize_metrics(m.neuron_preservation(_paired(spark, sf_dir)), ["variant"], ["pearson", "rmse", "nrmse"])
    wide = m.pivot_scorecard(m.tidy_summary(s, ["variant"]), ["variant"], ["pearson", "rmse", "nrmse"])
    trace = m.retained_energy(_paired(spark, sf_dir)).groupBy("variant").agg(F.avg("retained_energy").alias("energy"))
    return _rounded(m.one_to_one(trace, wide, ["variant"], "left"), "variant")


PIVOT = f"""WITH {VARIANTS}, {_SUMMARY}, e AS (SELECT recording, variant, neuron, var_pop(value) * count(*) AS e, var_pop(raw) * count(*) AS r FROM paired GROUP BY 1, 2, 3),
x AS (SELECT recording, variant, sum(e) / sum(r) AS q FROM e GROUP BY 1, 2)
SELECT variant, round(avg(q), 6) + 0.0 AS energy, round(any_value(pearson_mean), 6) + 0.0 AS pearson, round(any_value(rmse_mean), 6) + 0.0 AS rmse, round(any_value(nrmse_mean), 6) + 0.0 AS nrmse FROM x JOIN s USING (variant) GROUP BY 1"""


def labelled_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = m.trace_preservation(_paired(spark, sf_dir)).select("recording", F.col("variant").alias("method"), r6(F.col("pearson_median") * 100).alias("preservation"))
    return m.labelled_scorecard(card, "raw")


LABELLED = f"""WITH {VARIANTS}, c AS (SELECT recording, variant AS method, round(median(pearson) * 100, 6) + 0.0 AS preservation FROM per GROUP BY 1, 2),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording ORDER BY method <> 'raw', preservation DESC NULLS LAST, method) AS INTEGER) AS place FROM c)
SELECT recording, method, preservation, place, CASE WHEN method = 'raw' THEN 'raw reference' WHEN preservation IS NULL THEN 'insufficient data' WHEN place = 2 THEN 'best preserved' WHEN preservation >= 80 THEN 'acceptable'
 WHEN preservation >= 50 THEN 'information-loss risk' ELSE 'not recommended' END AS recommendation FROM p"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = m.variants_of(traces(spark, sf_dir))
    null = F.when(F.col("neuron") % 3 == 0, F.lit(None).cast("string")).otherwise("block_shuffle")
    fold = F.floor(F.col("time_index") / 50).cast("int")
    raw = traces(spark, sf_dir).select("recording", "time_index", "neuron", F.col("value").alias("y_true"))
    rows = v.join(raw, ["recording", "time_index", "neuron"]).withColumns({"null_strategy": null, "fold": fold, "method": F.col("variant")})
    pred = F.when(F.col("variant") == "raw", F.col("value") * 0.5).otherwise(F.col("value"))
    return rows.select("recording", "neuron", "fold", "time_index", "null_strategy", "method", "y_true", pred.alias("y_pred"))


_PAIRS = """p AS (SELECT v.recording, v.neuron, v.time_index, v.time_index // 50 AS fold, CASE WHEN v.neuron % 3 = 0 THEN NULL ELSE 'block_shuffle' END AS null_strategy, v.variant AS method, v.raw AS y_true, CASE WHEN v.variant = 'raw' THEN v.value * 0.5 ELSE v.value END AS y_pred FROM paired v),
j AS (SELECT a.*, b.y_pred AS y_ref FROM p a JOIN p b ON b.recording = a.recording AND b.neuron = a.neuron AND b.fold = a.fold AND b.time_index = a.time_index AND b.null_strategy IS NOT DISTINCT FROM a.null_strategy AND b.method = 'raw' WHERE a.method <> 'raw')"""


def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = m.paired_with_reference(_predictions(spark, sf_dir), "raw", ["recording", "neuron", "fold", "time_index"], ["null_strategy"])
    gain = (F.col("y_ref") - F.col("y_true")) ** 2 - (F.col("y_pred") - F.col("y_true")) ** 2
    return j.groupBy("recording", "method", "null_strategy", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(gain)).alias("mean_gain"))


PAIRED_PREDICTIONS = f"WITH {VARIANTS}, {_PAIRS} SELECT recording, method, null_strategy, fold::BIGINT AS fold, count(*) AS n, round(avg(pow(y_ref - y_true, 2) - pow(y_pred - y_true, 2)), 6) + 0.0 AS mean_gain FROM j GROUP BY 1, 2, 3, 4"


def prediction_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gain over the reference with the interval of a block bootstrap and the p of block sign flips, draw by draw."""
    j = m.paired_with_reference(_predictions(spark, sf_dir), "raw", ["recording", "neuron", "fold", "time_index"], ["null_strategy"])
    out = inference.prediction_uncertainty(j.withColumn("block", F.floor(F.col("time_index") / 10).cast("int")), "regression", ["recording", "method"], n_bootstrap=500, n_permutations=500)
    return out.select("recording", "method", "n", "n_blocks", *(r6(c).alias(c) for c in ("mean", "low", "high", "p")))


def _hash_steps(name: str, source: str, start: str) -> str:
    """CTEs that carry every column of source and add h, the mixed value of start."""
    low = "& 4294967295::UBIGINT"
    return f"""{name}1 AS (SELECT *, ({start}) {low} AS a FROM {source}), {name}2 AS (SELECT * EXCLUDE a, (xor(a, a >> 16) * 2246822507::UBIGINT) {low} AS a FROM {name}1),
{name}3 AS (SELECT * EXCLUDE a, (xor(a, a >> 13) * 3266489909::UBIGINT) {low} AS a FROM {name}2), {name} AS (SELECT * EXCLUDE a, xor(a, a >> 16) AS {name}_h FROM {name}3)"""


def _draws_sql(name: str, seed: int, draws: int) -> str:
    """name: recording, method, draw, place, blocks and the hash of each draw and block."""
    step = 2654435769
    return f"""{name}s AS (SELECT g.*, r.d AS draw FROM bl g, (SELECT unnest(range({draws}))::UBIGINT AS d) r),
{_hash_steps(name + "r", name + "s", f"draw + {step * (seed + 1) % 2**32}::UBIGINT")},
{_hash_steps(name, name + "r", f"{name}r_h + (({step}::UBIGINT * (place::UBIGINT + 1)) & 4294967295::UBIGINT)")}"""


UNCERTAINTY = f"""WITH {VARIANTS}, {_PAIRS}, gb AS (SELECT recording, method, time_index // 10 AS block, count(*) AS n, sum(pow(y_ref - y_true, 2) - pow(y_pred - y_true, 2)) AS total FROM j GROUP BY 1, 2, 3),
bl AS (SELECT *, row_number() OVER (PARTITION BY recording, method ORDER BY block) - 1 AS place, count(*) OVER (PARTITION BY recording, method) AS blocks FROM gb),
{_draws_sql("boot", 0, 500)}, {_draws_sql("flip", 1, 500)},
bs AS (SELECT b.recording, b.method, b.draw, sum(o.total) / sum(o.n) AS v FROM boot b JOIN bl o ON o.recording = b.recording AND o.method = b.method AND o.place = b.boot_h % b.blocks GROUP BY 1, 2, 3),
iv AS (SELECT recording, method, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM bs GROUP BY 1, 2),
tt AS (SELECT recording, method, sum(n) AS n, count(*) AS n_blocks, sum(total) AS total FROM bl GROUP BY 1, 2),
fs AS (SELECT recording, method, draw, sum(CASE WHEN flip_h & 1 = 1 THEN -total ELSE total END) AS v FROM flip GROUP BY 1, 2, 3),
pv AS (SELECT f.recording, f.method, (count_if(abs(f.v) >= abs(t.total) * (1 - 1e-9)) + 1) / 501.0 AS p FROM fs f JOIN tt t USING (recording, method) GROUP BY 1, 2)
SELECT recording, method, CAST(n AS BIGINT) AS n, n_blocks, round(total / n, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(p, 6) + 0.0 AS p FROM tt JOIN iv USING (recording, method) JOIN pv USING (recording, method)"""


def _unit_results(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col(unit).alias("recording"), F.col("c_mktsegment").alias("method"), F.col("c_acctbal").alias("value"))


def _effects_sql(unit: str, p: str) -> str:
    return f"""SELECT method, count(*) AS n_units, round(median(d), 6) + 0.0 AS median_difference, round(quantile_cont(d, 0.25), 6) + 0.0 AS q25, round(quantile_cont(d, 0.75), 6) + 0.0 AS q75,
 round(min(d), 6) + 0.0 AS min_difference, round(max(d), 6) + 0.0 AS max_difference, count_if(d > 0) AS n_positive, {p} AS p_sign_flip FROM
 (SELECT a.method, a.v - b.v AS d FROM (SELECT {unit} AS u, c_mktsegment AS method, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) a
  JOIN (SELECT {unit} AS u, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) b USING (u) WHERE a.method <> 'BUILDING') GROUP BY 1"""


def recording_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.recording_effects(_unit_results(spark, sf_dir, "n_nationkey"), "value", "BUILDING"), "method")


EFFECTS = _effects_sql("n_nationkey", "CAST(NULL AS DOUBLE)")


def unit_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.recording_effects(_unit_results(spark, sf_dir, "n_regionkey"), "value", "BUILDING"), "method")


UNIT_EFFECTS = f"""WITH d AS (SELECT a.method, a.u, a.v - b.v AS d FROM (SELECT n_regionkey AS u, c_mktsegment AS method, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) a
  JOIN (SELECT n_regionkey AS u, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) b USING (u) WHERE a.method <> 'BUILDING'),
l AS (SELECT method, list(d ORDER BY u) AS ds, len(list(d)) AS n FROM d GROUP BY 1), f AS (SELECT method, ds, n, unnest(range(1 << n)) AS f FROM l),
g AS (SELECT method, abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (f >> (i - 1)) & 1 = 1 THEN -x ELSE x END))) >= abs(list_sum(ds)) - 1e-9 AS hit FROM f),
p AS (SELECT method, round(avg(CAST(hit AS INTEGER)), 6) + 0.0 AS p_sign_flip FROM g GROUP BY 1), e AS ({_effects_sql("n_regionkey", "1.0")})
SELECT e.* EXCLUDE p_sign_flip, p.p_sign_flip FROM e JOIN p USING (method)"""


def bpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    s = li.groupBy(F.col("s_nationkey").alias("recording"), F.col("l_returnflag").alias("method"), F.concat(F.lit("c"), (F.col("l_linenumber") % 4).cast("string")).alias("component"))
    s = s.agg(F.avg("l_discount").alias("score"), F.avg("l_tax").alias("raw_score"), (F.min("l_discount") + 0.01).alias("null_score"))
    s = s.withColumn("scope", F.when(F.col("component") < "c2", "within").otherwise("transfer"))
    return _rounded(m.bpi_ablation(s, 1e-6, {"c1": 2.0, "c3": 0.5}), "recording", "method", "scope", "normalization", "weighting")


BPI = """WITH s AS (SELECT s_nationkey AS recording, l_returnflag AS method, 'c' || (l_linenumber % 4) AS component, avg(l_discount) AS score, avg(l_tax) AS raw, min(l_discount) + 0.01 AS nul FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
k AS (SELECT recording, method, CASE WHEN component < 'c2' THEN 'within' ELSE 'transfer' END AS scope, component, 'raw_null' AS normalization, CASE WHEN abs(raw - nul) > 1e-6 THEN 100.0 * (score - nul) / (raw - nul) END AS i FROM s
 UNION ALL SELECT recording, method, CASE WHEN component < 'c2' THEN 'within' ELSE 'transfer' END, component, 'raw_only', CASE WHEN abs(raw) > 1e-6 THEN 100.0 * score / raw END FROM s UNION ALL SELECT recording, method, CASE WHEN component < 'c2' THEN 'within' ELSE 'transfer' END, component, 'none', 100.0 * score FROM s),
w AS (SELECT k.*, 'equal' AS weighting, 1.0::DOUBLE AS w FROM k UNION ALL SELECT k.*, 'custom', CASE component WHEN 'c1' THEN 2.0::DOUBLE WHEN 'c3' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END FROM k),
a AS (SELECT recording, method, 'combined' AS scope, normalization, weighting, i, w FROM w UNION ALL SELECT recording, method, scope, normalization, weighting, i, w FROM w)
SELECT recording, method, scope, normalization, weighting, round(sum(i * w) / sum(w), 6) + 0.0 AS bpi, count(*) AS n_components FROM a WHERE i IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""


def artifact_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = frames(spark, sf_dir).select("recording").distinct().withColumn("center", F.explode(F.array(F.lit(40), F.lit(150))))
    return _rounded(m.artifact_distortion(_paired(spark, sf_dir), centers, 2, 6), "recording", "variant", "center", "neuron")


ARTIFACT = f"""WITH {VARIANTS}, a AS (SELECT recording, variant, center, neuron, avg(CASE WHEN abs(time_index - center) <= 2 THEN abs(value - raw) END) AS near, avg(CASE WHEN abs(time_index - center) > 6 THEN abs(value - raw) END) AS far FROM paired, (VALUES (40), (150)) c(center) GROUP BY 1, 2, 3, 4)
SELECT recording, variant, center, neuron, round(near, 6) + 0.0 AS near, round(far, 6) + 0.0 AS far, round(near / nullif(far, 0), 6) + 0.0 AS near_far_ratio FROM a"""


def pseudo_artifact_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE to raw, about made-up artifacts, of each variant and of plain interpolation."""
    centers = frames(spark, sf_dir).select("recording").distinct().withColumn("center", F.explode(F.array(F.lit(40), F.lit(150))))
    return _rounded(m.pseudo_artifact_error(_paired(spark, sf_dir), centers, 2), "recording", "center", "variant")


PSEUDO = f"""WITH {VARIANTS}, c AS (SELECT * FROM (VALUES (40), (150)) c(center)), n AS (SELECT recording, center, variant, value AS v, raw FROM paired, c WHERE abs(time_index - center) <= 2),
l AS (SELECT recording, center, neuron, max(CASE WHEN time_index = center - 3 THEN value END) AS a, max(CASE WHEN time_index = center + 3 THEN value END) AS b FROM traces, c GROUP BY 1, 2, 3),
i AS (SELECT t.recording, l.center, 'interpolation' AS variant, a + (b - a) * (time_index - l.center + 3) / 6.0 AS v, value AS raw FROM traces t JOIN l USING (recording, neuron) WHERE abs(time_index - l.center) <= 2)
SELECT recording, center, variant, round(sqrt(avg((v - raw) * (v - raw))), 6) + 0.0 AS rmse FROM (SELECT * FROM n UNION ALL SELECT * FROM i) GROUP BY 1, 2, 3"""


def representative_neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.representative_neurons(_paired(spark, sf_dir)).select("recording", "neuron", "place", r6("score", 5).alias("score"))


REPRESENTATIVE = f"""WITH {VARIANTS}, p AS (SELECT recording, neuron, stddev_pop(CASE WHEN variant = 'raw' THEN raw END) AS s, avg(CASE WHEN variant <> 'raw' THEN abs(value - raw) END) AS d FROM paired GROUP BY 1, 2),
z AS (SELECT recording, neuron, (s - avg(s) OVER w) / stddev_pop(s) OVER w + (d - avg(d) OVER w) / stddev_pop(d) OVER w AS score FROM p WINDOW w AS (PARTITION BY recording))
SELECT recording, neuron, CAST(k AS INTEGER) AS place, round(score, 5) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, neuron) AS k FROM z) WHERE k <= 12"""


def latent_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames(spark, sf_dir).select("recording", "time_index", F.col("x").alias("z"), F.col("level").alias("y"))
    return _rounded(m.latent_behavior_correlation(e, 1, ["recording"]), "recording", "latent")


LATENT = f"""WITH {WIDE}, d AS (SELECT recording, x, lead(level, 1) OVER (PARTITION BY recording ORDER BY time_index) AS y FROM wide), u AS (SELECT recording, y, CAST(unnest(range(len(x))) AS INTEGER) AS latent, unnest(x) AS z FROM d WHERE y IS NOT NULL)
SELECT recording, latent, round(covar_pop(z, y) / (stddev_pop(z) * stddev_pop(y)), 6) + 0.0 AS correlation, count(*) AS n FROM u GROUP BY 1, 2"""


def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"))
    return c.select("p_partkey", r6(m.percent_rank_average("size", ["p_brand"])).alias("score"))


PERCENT = "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) + 0.0 AS score FROM part"


def top_with_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("score", F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")))
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("score"), "o_orderkey")
    return o.withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey", "score")


TOP = "SELECT o_custkey, o_orderkey, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC NULLS LAST, o_orderkey) AS k FROM (SELECT *, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS score FROM orders)) WHERE k = 1"


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return setops.duplicate_flags(d, "sha256").select("doc_id", "sha256", "copies", "is_duplicate")


DUPLICATES = "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT doc_id, sha256, count(*) OVER (PARTITION BY sha256) AS copies, count(*) OVER (PARTITION BY sha256) > 1 AS is_duplicate FROM d"


def cumulative_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = traces(spark, sf_dir).groupBy("recording", "neuron").agg(F.var_pop("value").alias("energy"))
    return setops.first_reaching(e, "energy", "neuron", 0.6, ["recording"]).select("recording", F.col("n").cast("long").alias("n"), r6("reached").alias("reached"))


CUMULATIVE = f"""WITH {LONG}, e AS (SELECT recording, neuron, var_pop(value) AS energy FROM traces GROUP BY 1, 2), c AS (SELECT recording, row_number() OVER w AS rn, sum(energy) OVER w / sum(energy) OVER (PARTITION BY recording) AS q FROM e WINDOW w AS (PARTITION BY recording ORDER BY energy DESC, neuron))
SELECT recording, min(rn) AS n, round(min(q), 6) + 0.0 AS reached FROM c WHERE q >= 0.6 GROUP BY 1"""


def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    both = s.alias("a").join(F.broadcast(table(spark, sf_dir, "events").select("event_type").distinct().agg(F.collect_set("event_type").alias("all"))))
    return both.select("user_id", r6(setops.jaccard(F.col("kinds"), F.slice(F.array_sort("all"), 1, 3))).alias("jaccard"), F.array_join(F.array_sort(F.array_except("all", "kinds")), ";").alias("missing"))


OVERLAP = """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1), a AS (SELECT list_sort(list(DISTINCT event_type)) AS al FROM events)
SELECT user_id, round(len(list_intersect(k, al[1:3])) / len(list_distinct(list_concat(k, al[1:3]))), 6) + 0.0 AS jaccard, coalesce(array_to_string(list_sort(list_filter(al, lambda x: NOT list_contains(k, x))), ';'), '') AS missing FROM s, a"""


def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("recording", F.col("level").cast("int").alias("a"), (F.when(F.col("x")[0] > 0, 2).otherwise(0) + F.when(F.col("x")[1] > 0, 1).otherwise(0)).alias("b"))
    return _rounded(setops.adjusted_rand(rows, "a", "b", ["recording"]), "recording")


RAND = f"""WITH {WIDE}, r AS (SELECT recording, CAST(level AS INTEGER) AS a, CASE WHEN x[1] > 0 THEN 2 ELSE 0 END + CASE WHEN x[2] > 0 THEN 1 ELSE 0 END AS b FROM wide), c AS (SELECT recording, a, b, count(*) AS n FROM r GROUP BY 1, 2, 3),
i AS (SELECT recording, sum(n * (n - 1) / 2.0) AS i, sum(n) AS n FROM c GROUP BY 1), p AS (SELECT recording, sum(n * (n - 1) / 2.0) AS p FROM (SELECT recording, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), q AS (SELECT recording, sum(n * (n - 1) / 2.0) AS q FROM (SELECT recording, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT recording, round((i - p * q / (n * (n - 1) / 2.0)) / ((p + q) / 2.0 - p * q / (n * (n - 1) / 2.0)), 6) + 0.0 AS adjusted_rand FROM i JOIN p USING (recording) JOIN q USING (recording)"""


QUERIES = {
    "trace_preservation": trace_preservation, "neuron_preservation": neuron_preservation, "retained_energy": retained_energy, "autocorrelation_change": autocorrelation_change,
    "regression_metrics": regression_metrics, "classification_metrics": classification_metrics, "metric_summary": metric_summary, "tidy_summary": tidy_summary, "scorecard_pivot": scorecard_pivot,
    "labelled_scorecard": labelled_scorecard, "paired_predictions": paired_predictions, "prediction_uncertainty": prediction_uncertainty, "recording_effects": recording_effects, "unit_effects_exact_p": unit_effects,
    "bpi_ablation": bpi, "artifact_distortion": artifact_distortion, "pseudo_artifact_error": pseudo_artifact_error, "representative_neurons": representative_neurons, "latent_behavior_correlation": latent_correlation,
    "percent_rank_average": percent_ranks, "top_with_nulls_last": top_with_nulls_last, "duplicate_content": duplicates, "cumulative_energy": cumulative_energy, "set_overlap": set_overlap, "adjusted_rand": rand_index,
}
ORACLES = {
    "trace_preservation": TRACE, "neuron_preservation": NEURONS, "retained_energy": ENERGY, "autocorrelation_change": ACF, "regression_metrics": REGRESSION, "classification_metrics": CLASSIFICATION,
    "metric_summary": SUMMARY, "tidy_summary": TIDY, "scorecard_pivot": PIVOT, "labelled_scorecard": LABELLED, "paired_predictions": PAIRED_PREDICTIONS, "prediction_uncertainty": UNCERTAINTY,
    "recording_effects": EFFECTS, "unit_effects_exact_p": UNIT_EFFECTS, "bpi_ablation": BPI, "artifact_distortion": ARTIFACT, "pseudo_artifact_error": PSEUDO, "representative_neurons": REPRESENTATIVE,
    "latent_behavior_correlation": LATENT, "percent_rank_average": PERCENT, "top_with_nulls_last": TOP, "duplicate_content": DUPLICATES, "cumulative_energy": CUMULATIVE, "set_overlap": OVERLAP, "adjusted_rand": RAND,
}
