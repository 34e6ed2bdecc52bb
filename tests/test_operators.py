import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import bss, decoding, folds, inference, metrics, preprocess, setops
from tracewright.pipeline.evaluation import EvaluationConfig


def wide(spark, n=90, d=3, seed=1, recording=0):
    r = np.random.default_rng(seed)
    x = np.cumsum(r.normal(size=(n, d)), axis=0)
    return spark.createDataFrame([(recording, t, [float(v) for v in x[t]]) for t in range(n)], "recording int, time_index int, x array<double>"), x


def test_subset_keeps_order_and_each_cell_once(spark):
    long = spark.createDataFrame([(0, t, c, float(10 * c + t)) for t in range(2) for c in range(6)], "recording int, time_index int, neuron int, value double")
    roles = spark.createDataFrame([(0, [4, 1], [3, 5, 1])], "recording int, emitter array<int>, receiver array<int>")
    rows = preprocess.subset_cells(long, roles).filter("time_index = 0").orderBy("neuron").collect()
    assert [r["value"] for r in rows] == [40.0, 10.0, 30.0, 50.0]


def test_strict_zero_threshold(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (0, 0.0), (0, 1.0)], "recording int, v double")
    plain = preprocess.bout_state(df, "v", 0.5, ["recording"]).agg(F.sum("bout_state")).first()[0]
    strict = preprocess.bout_state(df, "v", 0.5, ["recording"], "strict_zero_threshold").agg(F.sum("bout_state")).first()[0]
    assert (plain, strict) == (4, 1)
    with pytest.raises(ValueError):
        preprocess.bout_threshold(df, "v", 0.5, ["recording"], "else")


def test_gap_must_cover_lags(spark):
    df, _ = wide(spark)
    with pytest.raises(ValueError):
        folds.fold_edges(df, 3, 1, required_gap=2)


def test_exact_sign_flip_of_equal_ones(spark):
    df = spark.createDataFrame([("m", 1.0)] * 4, "method string, d double")
    assert inference.exact_sign_flip(df, "d", ["method"]).first()["p_sign_flip"] == 2 / 16


def test_block_interval_brackets_the_mean(spark):
    df = spark.createDataFrame([("m", i // 10, 1.0 if i < 20 else 0.5) for i in range(40)], "method string, block int, d double")
    r = inference.block_inference(df, "d", ["method"], n_bootstrap=400, n_permutations=400).first()
    assert r["mean"] == 0.75 and r["low"] <= 0.75 <= r["high"] and 0 < r["p"] <= 1


def test_bpi_of_raw_is_100(spark):
    rows = [("r", m, c, s, v, 0.8, 0.5) for m, v in (("raw", 0.8), ("clean", 0.7)) for c, s in (("a", "within"), ("b", "transfer"))]
    df = spark.createDataFrame(rows, "recording string, method string, component string, scope string, score double, raw_score double, null_score double")
    out = {r["method"]: r["bpi"] for r in metrics.bpi_ablation(df).filter("scope = 'combined' AND normalization = 'raw_null' AND weighting = 'equal'").collect()}
    assert out["raw"] == pytest.approx(100) and out["clean"] == pytest.approx(100 * 0.2 / 0.3)


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        metrics.one_to_one(a, a.distinct(), ["k"])


def test_null_context_keys_match(spark):
    rows = [(0, t, None if t % 2 else "s", m, 1.0, p) for t in range(4) for m, p in (("raw", 0.0), ("clean", 1.0))]
    df = spark.createDataFrame(rows, "fold int, time_index int, null_strategy string, method string, y_true double, y_pred double")
    assert metrics.paired_with_reference(df, "raw", ["fold", "time_index"], ["null_strategy"]).count() == 4


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([("k", 1, 1, 0.5), ("k", 1, 0, 0.4)], "k string, y int, p int, s double")
    r = metrics.classification_metrics(df, "y", "p", ["k"], "s").first()
    assert r["balanced_accuracy"] is None and r["roc_auc"] is None
    flat = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0)], "k string, y double, p double")
    r = metrics.regression_metrics(flat, "y", "p", ["k"]).first()
    assert r["pearson"] is None and r["r2"] is None and r["nrmse"] is None


def test_jaccard_of_nothing_is_one(spark):
    assert spark.range(1).select(setops.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))).first()[0] == 1.0
    assert spark.range(1).select(setops.complement(F.array(F.lit(1)), 3)).first()[0] == [0, 2]


def test_held_out_frames_do_not_change_the_fit(spark):
    df, x = wide(spark)
    edges = folds.fold_edges(df, 3, 4)
    role = folds.fold_role()
    rows = df.join(edges.filter("fold = 1"), "recording").withColumn("role", role)
    spoiled = rows.withColumn("x", F.when(F.col("role") == "train", F.col("x")).otherwise(F.transform("x", lambda v: v * 100 + 7)))
    fit = lambda r: np.array([r_["unmixing"] for r_ in bss.fit_bss(r.filter("role = 'train'"), bss.fit_specs(("sobi",), (2,))).orderBy("component").collect()])
    assert np.allclose(fit(rows), fit(spoiled))


def test_decoding_ignores_frames_of_gaps_and_other_folds(spark):
    df, x = wide(spark, 120)
    v = df.withColumn("variant", F.lit("raw"))
    t = df.select("recording", "time_index", (F.col("x")[0] * 2 + 1).alias("y"))
    p = decoding.run_decoding(v, t, "regression", 3, 4, lags=(0, 1), alpha=1e-6)
    m = decoding.decoding_metrics(p, "regression").collect()
    assert len(m) == 3 and all(r["r2"] > 0.999 for r in m)
    tested = {(r["fold"], r["time_index"]) for r in p.collect()}
    assert all(f * 40 <= i < (f + 1) * 40 for f, i in tested)


def test_decoding_of_nulls_and_one_class(spark):
    df, _ = wide(spark, 90)
    v = df.withColumn("variant", F.lit("raw"))
    flat = df.select("recording", "time_index", F.lit(1.0).alias("y"))
    p = decoding.run_decoding(v, flat, "classification", 3, 4, nulls=[("block_shuffle", 0)])
    assert p.filter("y_score IS NOT NULL").count() == 0 and p.count() > 0


def test_latent_states_of_a_rotation(spark):
    t = np.arange(200)
    x = np.stack([np.sin(t / 5), np.cos(t / 5), np.sin(t / 5 + 1)], axis=1)
    df = spark.createDataFrame([(0, int(i), [float(v) for v in x[i]], "raw") for i in t], "recording int, time_index int, x array<double>, variant string")
    targets = df.select("recording", "time_index", F.col("x")[0].alias("angle"), F.abs(F.col("x")[1]).alias("vigor"))
    rows = decoding.latent_states(df, targets, 4, 2, 1, 2, 6, alpha=1e-6)
    m = decoding.latent_metrics(rows).collect()
    assert len(m) == 2 and all(r["dynamic_mse"] < 1e-3 * r["persistence_mse"] and r["angle_pearson"] > 0.99 for r in m)
    with pytest.raises(ValueError):
        decoding.latent_states(df, targets, 10, gap=3)


def test_configuration_coerces_and_refuses():
    c = EvaluationConfig.from_dict({"decoder_lags": [0, 2], "latent": {"window": 5, "transition_models": ["linear"]}})
    assert c.decoder_lags == (0, 2) and c.latent.window == 5 and c.latent.transition_models == ("linear",)
    with pytest.raises(TypeError):
        EvaluationConfig.from_dict({"nope": 1})


def test_user_methods_are_registered_and_checked(spark):
    from tracewright.operators import reports

    reports.register_method("lag_one", lambda x, depth: np.abs(np.corrcoef(x.T)) > 0)
    reports.register_method("wrong", lambda x, depth: np.zeros((2, 3)))
    df, _ = wide(spark)
    assert reports.user_edges(df, "lag_one", [1]).filter("source = target").count() == 0
    assert reports.user_edges(df, "lag_one", [1]).count() == 6
    with pytest.raises(ValueError):
        reports.register_method("wrong", lambda x, depth: x)
    with pytest.raises(KeyError):
        reports.user_edges(df, "nothing", [1])
    with pytest.raises(Exception, match="shape"):
        reports.user_edges(df, "wrong", [1]).collect()


def test_probes_keep_apart(spark):
    from tracewright.operators import reports

    rows = [(0, t, s) for t, s in enumerate([0.0, 9.0, 8.0, 1.0, 7.0, 2.0, 7.0, 0.0])]
    df = spark.createDataFrame(rows, "recording int, time_index int, score double")
    assert sorted(r["time_index"] for r in reports.separated_top(df, 3, 3, 1).collect()) == [1, 4]


def test_report_escapes(spark):
    from tracewright.operators import reports

    text = reports.html_report(spark.createDataFrame([("<b>", "drop")], "name string, recommendation string"), "t")
    assert "&lt;b&gt;" in text and 'class="drop"' in text


def test_spectral_preservation_of_tones(spark):
    """Half the power at 0.125 Hz, half at 1 Hz: halves of it taken away, scaled, or all of it."""
    t = np.arange(256)
    slow, fast = np.sin(2 * np.pi * t / 32), np.sin(2 * np.pi * t / 4)
    kinds = {"raw": slow + fast, "slow": slow, "fast": fast, "half": (slow + fast) / 2 + 3, "flat": 0 * t}
    rows = [(0, n, int(i), [float(x[i]), float(2 * x[i])]) for n, x in kinds.items() for i in t]
    df = spark.createDataFrame(rows, "recording int, variant string, time_index int, x array<double>")
    spectra = bss.panel_spectra(df, 4.0, 64, 32)
    assert spectra.count() == 10
    out = {r["variant"]: r for r in metrics.spectral_preservation(spectra, 4.0, 0.0, 0.2).collect()}
    retained = {n: (r["spectral_power_retention"], r["low_frequency_power_fraction"], r["low_frequency_power_fraction_delta"]) for n, r in out.items()}
    wanted = {"raw": (1, 0.5, 0), "slow": (0.5, 1, 0.5), "fast": (0.5, 0, -0.5), "half": (0.25, 0.5, 0)}
    assert retained.pop("flat") == (0, None, None)
    assert all(retained[n] == pytest.approx(w, abs=1e-9) for n, w in wanted.items()) and retained.keys() == wanted.keys()
    nothing = metrics.spectral_preservation(spectra, 4.0, 0.01, 0.02).filter("variant = 'raw'").first()
    assert nothing["spectral_power_retention"] == 1 and nothing["low_frequency_power_fraction"] is None


def test_rebuilt_variants_equal_long_reconstruction(spark):
    df, _ = wide(spark, n=60, d=4)
    rows = df.withColumns({"fold": F.lit(0), "role": F.lit("train")})
    keys = ["recording", "fold", "spec"]
    fitted = bss.fit_bss(rows, bss.fit_specs(("sobi",)), ("recording", "fold")).cache()
    kept = fitted.select(*keys, "component", F.explode(F.array(F.lit("some"), F.lit("all"))).alias("name")).filter("name = 'all' OR component IN (0, 2)")
    got = {(r["variant"], r["time_index"]): r["x"] for r in bss.rebuilt(rows, fitted, kept, chunk=7).collect()}
    assert len(got) == 120
    mixing, means = bss.mixing_long(fitted, ("recording", "fold")).filter("component IN (0, 2)"), bss.means_long(fitted, ("recording", "fold"))
    for r in bss.reconstruct(bss.transform(rows, fitted, ("recording", "fold")), mixing, means, keys).collect():
        assert got["sobi/some", r["time_index"]][r["neuron"]] == pytest.approx(r["value"], abs=1e-9)
    whole = np.array([r["x"] for r in df.orderBy("time_index").collect()])
    assert np.allclose(np.array([got["sobi/all", t] for t in range(60)]), whole)


def test_matched_pca_holds_the_share_with_the_fewest_axes(spark):
    df, x = wide(spark, n=80, d=5)
    rows = df.withColumns({"fold": F.lit(0), "role": F.lit("train")})
    shares = spark.createDataFrame([(0, 0, "a", 0.5), (0, 0, "b", 0.97), (0, 0, "c", 1.0), (0, 0, "d", 2.0)], "recording int, fold int, source string, share double")
    named = {s: r for r in bss.matched_pca(rows, shares).filter("sources IS NOT NULL").collect() for s in r["sources"]}
    v = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    run = np.cumsum(v) / v.sum()
    for source, share in (("a", 0.5), ("b", 0.97)):
        rank = int(np.searchsorted(run, share)) + 1
        assert named[source]["variant"] == f"pca_energy_match/rank{rank}" and named[source]["matched_share"] == pytest.approx(run[rank - 1])
    assert named["c"]["variant"] == named["d"]["variant"] == "pca_energy_match/rank5"


def test_removal_sums_add_up_over_chunks_and_leave_unknown_cells_out(spark):
    from tracewright.operators import quality

    r = np.random.default_rng(4)
    z, a, ref = r.normal(size=(50, 3)), r.normal(size=(3, 4)), r.normal(size=(50, 4))
    components = spark.createDataFrame([(0, k, t, float(z[t, k])) for t in range(50) for k in range(3)], "recording int, component int, time_index int, value double")
    mixing = spark.createDataFrame([(0, k, n, float(a[k, n])) for k in range(3) for n in range(4)], "recording int, component int, neuron int, weight double")
    reference = spark.createDataFrame([(0, t, n, float(ref[t, n]) if (t, n) != (3, 1) else None) for t in range(50) for n in range(4)], "recording int, time_index int, neuron int, value double")
    groups = spark.createDataFrame([(0, "x", 0), (0, "x", 2), (0, "y", 1)], "recording int, group string, component int")
    got = {g["group"]: g for g in quality.removal_validation(components, mixing, reference, groups, chunk=8).collect()}
    known = np.ones((50, 4), bool)
    known[3, 1] = False
    for name, members in (("x", [0, 2]), ("y", [1])):
        gone, full = z[:, members] @ a[members], z @ a
        left = full - gone
        assert got[name]["mean_abs_delta"] == pytest.approx(np.abs(gone)[known].mean())
        assert got[name]["reference_corr_removed"] == pytest.approx(np.corrcoef(ref[known], left[known])[0, 1])
        ratio = [left[known[:, n], n].var() / ref[known[:, n], n].var() for n in range(4)]
        assert got[name]["variance_ratio_median_removed"] == pytest.approx(np.median(ratio))


# The names of a settings file, here with small values.
SETTINGS = {
    "n_splits": 2, "gap": 4, "bss_methods": ["fastica", "sobi", "jade"], "n_components": None, "bss_pca_components": 3, "bss_pca_variance_threshold": None, "bss_tolerance": 0.0001, "bss_max_iter": 100,
    "sobi_lags": [1, 2], "jade_max_cumulant_matrices": 20, "n_clusters": 2, "keep_cluster_counts": [1], "selection_strategies": ["low_frequency", "random", "energy_matched_random", "all"],
    "selection_random_seeds": [0, 1], "cluster_stability_seeds": [0, 1], "cluster_stability_counts": [2], "cluster_stability_feature_transforms": ["raw", "log1p"], "cluster_stability_keep_count": 1,
    "feature_start_bin": 1, "feature_transform": "log1p", "welch_nperseg": 32, "welch_noverlap": 16, "ranking_fmin_hz": 0.0, "ranking_fmax_hz": 1.0, "ranking_aggregate": "peak", "baseline_ranks": [2],
    "benchmark_latent_methods": [], "benchmark_latent_ranks": [], "ic_quality_selection_strategies": ["ic_quality_nonartifact"], "bss_component_counts": [], "bss_pca_variance_thresholds": [],
    "include_energy_matched_pca": True, "lowpass_cutoffs_hz": [], "decoder_lags": [0, 1], "decoder_target_shift": 0, "decoder_ridge_alpha": 10.0, "bout_quantile": 0.75, "target_bout_quantiles": [0.6],
    "target_smooth_windows": [3], "null_block_size": 10, "null_block_sizes": [5, 10], "null_seeds": [0, 1], "null_strategies": ["block_shuffle", "circular_shift"], "null_circular_min_shift": 10,
    "uncertainty_block_size": 10, "uncertainty_n_bootstrap": 50, "uncertainty_n_permutations": 50, "random_state": 0, "causal_transition_models": ["linear"], "causal_sufficiency_targets": ["vigor", "angle"],
    "artifact_probe_centers": [20], "artifact_probe_half_width": 2,
    "causal": {"window": 3, "target_shifts": [0, 2], "latent_dim": 2, "n_splits": 2, "gap": 4, "ridge_alpha": 10.0, "random_state": 0, "transition_model": "linear", "mlp_hidden_units": 4, "mlp_max_iter": 10},
}


def test_a_settings_file_with_every_name_runs(spark, tmp_path):
    import json

    from tracewright.pipeline.evaluation import manifest, run_evaluation

    (tmp_path / "settings.json").write_text(json.dumps(SETTINGS))
    config = EvaluationConfig.from_json(tmp_path / "settings.json", sample_rate_hz=4.0)
    assert config.latent.target_shifts == (0, 2) and config.transitions == ("linear",)
    with pytest.raises(TypeError):
        EvaluationConfig.from_dict({"causal": {"nope": 1}})
    df, x = wide(spark, n=120, d=4)
    targets = spark.createDataFrame([(0, t, float(x[t, 0]), float(abs(x[t, 1]))) for t in range(120)], "recording int, time_index int, angle double, vigor double")
    tables = run_evaluation(df, targets, config)
    values = lambda table, *columns: {tuple(r) if len(columns) > 1 else r[0] for r in tables[table].select(*columns).distinct().collect()}
    said = json.loads(manifest(spark, tables, config))
    assert all(t["rows"] for t in said["tables"].values()) and said["fits"]["all"] == 6
    # sobi and jade keep the PCA's three axes, fastica all four
    assert {(r["method"], r["n"]) for r in tables["models"].filter("fold = 0").groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()} == {("fastica", 4), ("sobi", 3), ("jade", 3)}
    assert values("behavior_vigor", "null_strategy", "null_block_size") == {(None, None), ("block_shuffle", 5), ("block_shuffle", 10), ("circular_shift", None)}
    assert values("behavior_bout_grid", "target_variant") == values("behavior_vigor_grid", "target_variant") == {"primary", "q0.75_smooth3", "q0.6_smooth1", "q0.6_smooth3"}
    assert values("latent_metrics", "target_shift") == {0, 2} and values("markov_sufficiency", "target") == {"vigor", "angle"}
    assert tables["cluster_stability"].count() == 2 * 3 * 6  # folds, fits, pairs of four labelings
    assert tables["cluster_stability"].filter("NOT retained_jaccard BETWEEN 0 AND 1").count() == 0
    matches = tables["energy_matches"].collect()
    assert len(matches) == 2 * 3 * 6 and all(m["matched_share"] >= min(m["share"], 1) - 1e-9 for m in matches)
    energy = {(r["fold"], r["variant"]): r for r in tables["variant_metadata"].collect()}
    assert energy[0, "fastica/all/all"]["keep_components"] == [0, 1, 2, 3] and energy[0, "raw"]["keep_components"] is None


def test_more_units_than_exact_flips_take_raise(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(21)], "method string, d double")
    with pytest.raises(Exception, match="20 differences"):
        inference.exact_sign_flip(df, "d", ["method"]).collect()


def test_wide_pairs_are_those_of_long_rows(spark):
    rows = [(r, v, t, [float(r + t + k), None if t == 1 else 2.0 * k]) for r in range(2) for k, v in enumerate(("raw", "low")) for t in range(3) if (r, v, t) != (1, "raw", 2)]
    wide = spark.createDataFrame(rows, "recording int, variant string, time_index int, x array<double>")
    long = wide.select("recording", "variant", "time_index", F.posexplode("x").alias("neuron", "value"))
    columns = ["recording", "variant", "time_index", "neuron", "value", "raw"]
    got = metrics.long_pairs(metrics.wide_against(wide)).select(columns).collect()
    assert len(got) == 20 and sorted(map(str, got)) == sorted(map(str, metrics.against(long).select(columns).collect()))


def test_effects_of_many_units_have_no_exact_p(spark):
    rows = [(u, m, float(u)) for m, n in (("raw", 21), ("few", 20), ("many", 21)) for u in range(n)]
    got = {r["method"]: r for r in metrics.recording_effects(spark.createDataFrame(rows, "recording int, method string, value double"), "value", "raw").collect()}
    assert got["few"]["n_units"] == 20 and got["few"]["p_sign_flip"] == 1.0
    assert got["many"]["n_units"] == 21 and got["many"]["p_sign_flip"] is None


def test_latent_states_of_given_edges_are_those_of_their_fold(spark):
    r = np.random.default_rng(3)
    x = np.cumsum(r.normal(size=(160, 4)), axis=0)
    df = spark.createDataFrame([(0, "raw", t, [float(v) for v in x[t]]) for t in range(160)], "recording int, variant string, time_index int, x array<double>")
    targets = spark.createDataFrame([(0, t, float(x[t, 0]), float(abs(x[t, 1]))) for t in range(160)], "recording int, time_index int, angle double, vigor double")
    options = {"window": 3, "latent_dim": 2, "shift": (1, 2), "n_splits": 4, "gap": 4, "transitions": ("linear", "mlp"), "rounds": 20}
    every = {tuple(map(str, v)) for v in decoding.latent_states(df, targets, **options).filter("fold = 2").collect()}
    edges = folds.fold_edges(df, 4, 4).filter("fold = 2")
    own = decoding.latent_states(df, targets, edges=edges, **options).collect()
    assert {tuple(map(str, v)) for v in own} == every and {(v["transition"], v["target_shift"]) for v in own} == {(a, b) for a in ("linear", "mlp") for b in (1, 2)}


def test_report_is_ordered_and_says_what_it_leaves_out(spark):
    from tracewright.operators import reports

    page = reports.html_report(spark.range(5).withColumn("recommendation", F.lit("keep")).orderBy(F.desc("id")), "t", 2)
    assert page.index("<td>0</td>") < page.index("<td>1</td>") and "<td>2</td>" not in page and "3 more rows" in page
