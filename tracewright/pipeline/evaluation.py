"""A full evaluation of all recordings at once: variants per fold, preservation, decoding, latent states, probes, audit and effects.

The recordings are a key like any other, so nothing loops over them; the driver only loops over the configured variants.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bss, chunked, decoding, folds, graphs, inference, lagged, metrics, preprocess, quality
from ..scratch import saved


@dataclass(frozen=True)
class LatentConfig:
    # Names and defaults of the settings file's part `causal`; folds and gap are those of the evaluation.
    window: int = 15
    target_shifts: tuple[int, ...] = (0, 1, 2, 4)
    latent_dim: int = 3
    n_splits: int = 5
    gap: int = 14
    ridge_alpha: float = 5.0
    bout_quantile: float = 0.75
    random_state: int = 0
    transition_model: str = "linear"
    mlp_hidden_units: int = 16
    mlp_max_iter: int = 500
    # Our own: several transition models at once.
    transition_models: tuple[str, ...] = ()


@dataclass(frozen=True)
class EvaluationConfig:
    sample_rate_hz: float = 4.0
    # Names and defaults of the settings file.
    n_splits: int = 5
    gap: int = 14
    bss_methods: tuple[str, ...] = ("fastica", "infomax", "sobi", "jade")
    n_components: int | None = None
    bss_pca_components: int | None = None
    bss_pca_variance_threshold: float | None = None
    bss_tolerance: float = 1e-4
    bss_max_iter: int = 500
    sobi_lags: tuple[int, ...] = (1, 2, 3, 5)
    jade_max_cumulant_matrices: int = 200
    n_clusters: int = 7
    keep_cluster_counts: tuple[int, ...] = (1, 2)
    selection_strategies: tuple[str, ...] = ("low_frequency", "high_frequency", "random", "energy_matched_random", "all")
    selection_random_seeds: tuple[int, ...] = (0,)
    cluster_stability_seeds: tuple[int, ...] = (0,)
    cluster_stability_counts: tuple[int, ...] = ()
    cluster_stability_feature_transforms: tuple[str, ...] = ()
    cluster_stability_keep_count: int = 1
    feature_start_bin: int = 30
    feature_transform: str = "log1p"
    welch_nperseg: int = 250
    welch_noverlap: int = 125
    ranking_fmin_hz: float = 0.0
    ranking_fmax_hz: float = 0.2
    ranking_aggregate: str = "peak"
    baseline_ranks: tuple[int, ...] = ()
    benchmark_latent_methods: tuple[str, ...] = ()
    benchmark_latent_ranks: tuple[int, ...] = ()
    ic_quality_selection_strategies: tuple[str, ...] = ()
    bss_component_counts: tuple[int, ...] = ()
    bss_pca_variance_thresholds: tuple[float, ...] = ()
    include_energy_matched_pca: bool = True
    lowpass_cutoffs_hz: tuple[float, ...] = (0.2,)
    decoder_lags: tuple[int, ...] = (0, 1, 2)
    decoder_target_shift: int = 0
    decoder_ridge_alpha: float = 10.0
    bout_quantile: float = 0.75
    target_bout_quantiles: tuple[float, ...] = ()
    target_smooth_windows: tuple[int, ...] = ()
    null_block_size: int = 60
    null_block_sizes: tuple[int, ...] = ()
    null_seeds: tuple[int, ...] = (0,)
    null_strategies: tuple[str, ...] = ("block_shuffle",)
    null_circular_min_shift: int = 60
    uncertainty_block_size: int = 60
    uncertainty_n_bootstrap: int = 2000
    uncertainty_n_permutations: int = 5000
    random_state: int = 0
    causal_transition_models: tuple[str, ...] = ()
    causal_sufficiency_targets: tuple[str, ...] = ("vigor",)
    artifact_probe_centers: tuple[int, ...] = ()
    artifact_probe_half_width: int = 2
    latent: LatentConfig = field(default_factory=LatentConfig)

    @classmethod
    def from_json(cls, path: str | Path, **more) -> EvaluationConfig:
        """Lists become tuples; unknown keys raise."""
        return cls.from_dict(json.loads(Path(path).read_text()) | more)

    @classmethod
    def from_dict(cls, values: dict) -> EvaluationConfig:
        """Settings by their names in a settings file, where the part of the latent model is called `causal` (or `latent`)."""
        values = dict(values)
        if "causal" in values:
            if "latent" in values:
                raise TypeError("give causal or latent, not both")
            values["latent"] = values.pop("causal")
        tuples = lambda part: {k: tuple(v) if isinstance(v, list) else v for k, v in part.items()}
        inner = values.get("latent")
        unknown = set(values) - {f.name for f in fields(cls)} | (set(inner) - {f.name for f in fields(LatentConfig)} if isinstance(inner, dict) else set())
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        if isinstance(inner, dict):
            values["latent"] = LatentConfig(**tuples(inner))
        return cls(**tuples(values))

    @property
    def transitions(self) -> tuple[str, ...]:
        return self.causal_transition_models or self.latent.transition_models or (self.latent.transition_model,)

    @property
    def nulls(self) -> list[decoding.Null]:
        sizes = {"block_shuffle": tuple(dict.fromkeys(self.null_block_sizes or (self.null_block_size,)))}
        return [decoding.Null(strategy, seed, size) for strategy in self.null_strategies for size in sizes.get(strategy, (None,)) for seed in self.null_seeds]

    @property
    def selections(self) -> list[bss.Selection]:
        out = []
        for strategy in self.selection_strategies:
            seeds = self.selection_random_seeds if "random" in strategy else (self.random_state,)
            out += [bss.Selection(strategy, k, seed) for k in ((None,) if strategy == "all" else self.keep_cluster_counts) for seed in seeds]
        return out

    @property
    def target_variants(self) -> list[tuple[str, float, int]]:
        """Name, bout quantile and smoothing window of each target variant; the first is the primary one."""
        pairs = dict.fromkeys((float(q), int(w)) for q in (self.bout_quantile, *self.target_bout_quantiles) for w in (1, *self.target_smooth_windows))
        if any(not 0 <= q <= 1 or w < 1 for q, w in pairs):
            raise ValueError("quantiles lie between 0 and 1, windows are 1 or more")
        return [("primary" if i == 0 else f"q{q:.3g}_smooth{w}", q, w) for i, (q, w) in enumerate(pairs)]


KEYS = ("recording", "fold")


def fold_variants(frames: DataFrame, roles: DataFrame, config: EvaluationConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """variants(recording, fold, variant, family, time_index, role, x) and the tables made on the way: models, clusters, their stability,
    quality, selections and what each variant is made of.
    """
    rows = saved(frames.join(roles, ["recording", "time_index"]), "fold-frames")
    train = rows.filter("role = 'train'")
    pick = ["recording", "fold", "variant", "family", "time_index", "role", "x"]
    parts = [rows.withColumns({"variant": F.lit("raw"), "family": F.lit("raw")}).select(*pick)]
    specs = bss.fit_specs(config.bss_methods, config.bss_component_counts or (config.n_components,), config.bss_pca_variance_thresholds)
    fitted = bss.fit_bss(train, specs, KEYS, config.bss_tolerance, config.bss_max_iter, config.random_state, config.sobi_lags, config.jade_max_cumulant_matrices, config.bss_pca_components, config.bss_pca_variance_threshold)
    fitted = saved(fitted, "models")
    on = [*KEYS, "spec"]
    of_train = saved(bss.transform(train, fitted, KEYS), "components")
    spectra = saved(bss.welch_spectra(of_train, config.sample_rate_hz, config.welch_nperseg, config.welch_noverlap, [*on, "component"]), "spectra")
    band = (config.sample_rate_hz, config.ranking_fmin_hz, config.ranking_fmax_hz, config.ranking_aggregate)
    clustered = saved(bss.cluster_components(spectra, config.n_clusters, config.feature_transform, config.feature_start_bin, config.random_state, on), "clusters")
    ranked = saved(bss.rank_clusters(clustered, *band, on), "cluster-ranks")
    own = clustered.select(*on, "component", "cluster").join(fitted.select(*on, "component", "energy"), [*on, "component"])
    mixing = bss.mixing_long(fitted, KEYS)
    temporal = quality.temporal_features(of_train, keys=[*on, "component"])
    loads = quality.loading_features(mixing, keys=[*on, "component"])
    table = temporal.join(loads, [*on, "component"]).join(quality.spectral_features(spectra, keys=[*on, "component"]), [*on, "component"])
    judged = saved(quality.scored(table, keys=on), "quality")
    tables = {"models": fitted, "cluster_ranking": ranked, "ic_quality": judged}

    if config.cluster_stability_counts and config.cluster_stability_feature_transforms and config.cluster_stability_seeds:
        named = [*on, "labeling"]
        swept = saved(bss.cluster_sweep(spectra, config.cluster_stability_counts, config.cluster_stability_feature_transforms, config.cluster_stability_seeds, config.feature_start_bin, on), "sweep")
        order = bss.rank_clusters(swept, *band, named).select(*named, "cluster", F.col("rank").alias("cluster_rank"))
        labels = swept.drop("power").join(order, [*named, "cluster"]).withColumn("retained", F.col("cluster_rank") <= max(1, config.cluster_stability_keep_count))
        tables["cluster_stability_assignments"] = labels = saved(labels, "labelings")
        tables["cluster_stability"] = graphs.labeling_stability(labels, on)

    chosen = [bss.select_all(ranked, own, config.selections, on).select(*on, "component", "name")] if config.selections else []
    by_quality = [quality.select_by_quality(judged, s).select(*on, "component", F.lit(s).alias("name")) for s in config.ic_quality_selection_strategies]
    made_of = None
    if chosen + by_quality:
        kept = (chosen + by_quality)[0]
        for more in (chosen + by_quality)[1:]:
            kept = kept.unionByName(more)
        tables["component_selection"] = kept = saved(kept, "selections")
        parts.append(bss.rebuilt(rows, fitted, kept, KEYS).withColumn("family", F.lit("bss")).select(*pick))
        made_of = kept.groupBy(*KEYS, F.concat_ws("/", "spec", "name").alias("variant")).agg(F.sort_array(F.collect_list("component")).alias("keep_components"))
        if chosen and config.include_energy_matched_pca:
            shares = bss.energy_shares(fitted, kept.filter(~F.col("name").isin(*config.ic_quality_selection_strategies)), train, KEYS)
            matched = saved(bss.matched_pca(rows, shares, KEYS), "matched-pca")
            tables["energy_matches"] = matched.filter("sources IS NOT NULL").select(*KEYS, "variant", F.explode(F.arrays_zip("sources", "shares")).alias("_s"), "matched_share").select(*KEYS, "variant", F.col("_s.sources").alias("source"), F.col("_s.shares").alias("share"), "matched_share")
            parts.append(matched.withColumn("family", F.lit("baseline")).select(*pick))
    kinds = [("pca", r, 0) for r in config.baseline_ranks] + [("random_subspace", r, s) for r in config.baseline_ranks for s in config.selection_random_seeds]
    latent = [(m, r, config.random_state) for m in config.benchmark_latent_methods for r in config.benchmark_latent_ranks]
    for family, wanted in (("baseline", kinds), ("latent_benchmark", latent)):
        if wanted:
            parts.append(bss.project_by_fold(rows, wanted, KEYS).withColumn("family", F.lit(family)).select(*pick))
    if config.lowpass_cutoffs_hz:
        parts.append(chunked.lowpass(rows, config.lowpass_cutoffs_hz, config.sample_rate_hz, KEYS).withColumn("family", F.lit("baseline")).select(*pick))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = saved(out, "variants")
    known = out.select(*KEYS, "variant", "family").distinct()
    tables["variant_metadata"] = known.join(made_of, [*KEYS, "variant"], "left") if made_of is not None else known.withColumn("keep_components", F.lit(None).cast("array<int>"))
    return out, tables


def _target_columns(targets: DataFrame, windows: Sequence[int]) -> DataFrame:
    """angle, vigor and vigor_<w>, its mean over each window of more than one frame."""
    for w in windows:
        targets = preprocess.moving_average(targets, "vigor", w, ["recording"], "time_index", f"vigor_{w}")
    return targets


def _behavior(by_unit: DataFrame, targets: DataFrame, edges: DataFrame, config: EvaluationConfig) -> dict[str, DataFrame]:
    """Predictions of all targets from one pass over the variants, and the metrics of the primary ones and of every target variant."""
    variants = config.target_variants
    column = lambda w: "vigor" if w == 1 else f"vigor_{w}"
    state = lambda name: "bout_state" if name == "primary" else f"bout_state/{name}"
    wanted = [decoding.Target("angle", "angle")] + [decoding.Target(column(w), column(w)) for w in dict.fromkeys(w for _, _, w in variants)]
    wanted += [decoding.Target(state(name), column(w), q) for name, q, w in variants]
    options = {"lags": config.decoder_lags, "shift": config.decoder_target_shift, "alpha": config.decoder_ridge_alpha, "nulls": config.nulls, "null_min_shift": config.null_circular_min_shift}
    predictions = saved(decoding.decode(by_unit, targets, edges, wanted, **options), "predictions")
    is_state = F.col("target").startswith("bout_state")
    regression, states = decoding.decoding_metrics(predictions.filter(~is_state), "regression"), decoding.decoding_metrics(predictions.filter(is_state), "classification")
    out = {f"predictions_{t}": predictions.filter(F.col("target") == t) for t in ("angle", "vigor", "bout_state")}
    out |= {"behavior_angle": regression.filter("target = 'angle'"), "behavior_vigor": regression.filter("target = 'vigor'"), "behavior_bout_state": states.filter("target = 'bout_state'")}
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("target_variant"), F.lit(q).alias("bout_quantile"), F.lit(w).alias("smooth_window")) for n, q, w in variants))).alias("_g")
    of_vigor, of_state = F.when(F.col("_g.smooth_window") == 1, "vigor").otherwise(F.concat(F.lit("vigor_"), "_g.smooth_window")), F.when(F.col("_g.target_variant") == "primary", "bout_state").otherwise(F.concat(F.lit("bout_state/"), "_g.target_variant"))
    out["behavior_vigor_grid"] = regression.select("*", grid).filter(F.col("target") == of_vigor).select("*", "_g.*").drop("_g")
    out["behavior_bout_grid"] = states.select("*", grid).filter(F.col("target") == of_state).select("*", "_g.*").drop("_g")
    return out


def run_evaluation(frames: DataFrame, targets: DataFrame, config: EvaluationConfig) -> dict[str, DataFrame]:
    """All result tables. frames(recording, time_index, x), targets(recording, time_index, angle, vigor)."""
    frames = frames.select("recording", "time_index", "x")
    needed = max(max(config.decoder_lags), config.latent.window - 1)
    roles = saved(folds.strict_folds(frames, config.n_splits, config.gap, required_gap=needed).select("recording", "fold", "time_index", "role", "start", "stop", "gap", "n"), "roles")
    variants, tables = fold_variants(frames, roles.select("recording", "fold", "time_index", "role"), config)
    edges = roles.select("recording", "fold", "start", "stop", "gap", "n").distinct()
    unit = F.concat_ws("#", "recording", "fold").alias("unit")

    # each (recording, fold) is a unit of its own: variants differ by fold, and a job only uses its own fold's edges
    by_unit = variants.select(unit, "variant", "time_index", "x").withColumnRenamed("unit", "recording")
    unit_edges = edges.select(unit, "fold", "start", "stop", "gap", "n").withColumnRenamed("unit", "recording")
    windows = sorted({w for _, _, w in config.target_variants} - {1})
    smoothed = _target_columns(targets.select("recording", "time_index", "angle", "vigor"), windows)
    unit_targets = smoothed.join(edges.select("recording", "fold"), "recording").withColumn("recording", F.concat_ws("#", "recording", "fold")).drop("fold")
    behavior = _behavior(by_unit, unit_targets, unit_edges, config)

    held_out = variants.filter("role = 'test'").select(*KEYS, "variant", "time_index", "x")
    paired = metrics.long_pairs(saved(metrics.wide_against(held_out, keys=KEYS), "held-out"), KEYS)
    trace = metrics.trace_preservation(paired, KEYS).join(metrics.retained_energy(paired, KEYS), [*KEYS, "variant"])
    spectra = saved(bss.panel_spectra(held_out, config.sample_rate_hz, config.welch_nperseg, config.welch_noverlap, [*KEYS, "variant"]), "held-out-spectra")
    trace = trace.join(metrics.spectral_preservation(spectra, config.sample_rate_hz, config.ranking_fmin_hz, config.ranking_fmax_hz, keys=KEYS), [*KEYS, "variant"])
    lags = sorted({lag for lag in (*config.decoder_lags, *config.sobi_lags) if lag > 0})
    temporal = lagged.temporal_dependence_change(held_out, lags, keys=KEYS)
    latent = saved(_latent(variants, targets, edges, config), "latent")
    sufficiency = None
    for target in config.causal_sufficiency_targets:
        own = decoding.markov_sufficiency(latent, target).withColumn("target", F.lit(target))
        sufficiency = own if sufficiency is None else sufficiency.unionByName(own)
    audit = folds.leakage_audit(roles.filter("role = 'train'").select(F.explode(F.array(*map(F.lit, ("bss_fit", "cluster_fit", "quality_fit", "scaler_fit", "decoder_fit", "latent_fit")))).alias("operation"), *KEYS, "time_index"), roles)
    folds.assert_leak_free(audit)
    effects = metrics.recording_effects(trace.select(F.concat_ws("#", *KEYS).alias("unit"), F.col("variant").alias("method"), "pearson_median"), "pearson_median", "raw", "unit")
    within = behavior["predictions_vigor"].filter("comparison = 'within'").select("recording", "fold", "time_index", F.col("test_version").alias("method"), "y_true", "y_pred")
    matched = metrics.paired_with_reference(within, "raw", ["recording", "fold", "time_index"]).withColumn("block", F.floor(F.col("time_index") / config.uncertainty_block_size).cast("int"))
    uncertainty = inference.prediction_uncertainty(matched, "regression", ["recording", "method"], n_bootstrap=config.uncertainty_n_bootstrap, n_permutations=config.uncertainty_n_permutations)
    out = tables | behavior | {
        "folds": roles, "trace_metrics": trace, "temporal_metrics": temporal, "latent_metrics": decoding.latent_metrics(latent),
        "latent_rows": latent, "leakage_audit": audit, "recording_effects": effects, "prediction_uncertainty": uncertainty,
    }
    if sufficiency is not None:
        out["markov_sufficiency"] = sufficiency
    if config.artifact_probe_centers:
        centers = edges.withColumn("center", F.explode(F.array(*map(F.lit, config.artifact_probe_centers))))
        inside = centers.filter((F.col("center") >= F.col("start") + config.artifact_probe_half_width + 1) & (F.col("center") < F.col("stop") - config.artifact_probe_half_width - 1)).select(*KEYS, "center")
        out["artifact_probes"] = metrics.pseudo_artifact_error(paired, inside, config.artifact_probe_half_width, keys=KEYS)
        out["artifact_distortion"] = metrics.artifact_distortion(paired, inside, config.artifact_probe_half_width, 3 * config.artifact_probe_half_width, KEYS)
    return out


def _latent(variants: DataFrame, targets: DataFrame, edges: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Latent rows for every fold's own variants; rows of a (recording, fold) unit are only tested in that fold."""
    unit = F.concat_ws("#", "recording", "fold").alias("recording")
    own = variants.select(unit, "variant", "time_index", "x")
    t = targets.join(edges.select("recording", "fold"), "recording").select(unit, "time_index", "angle", "vigor")
    c = config.latent
    options = {"alpha": c.ridge_alpha, "bout_quantile": c.bout_quantile, "transitions": config.transitions, "seed": c.random_state, "hidden": c.mlp_hidden_units, "rounds": c.mlp_max_iter}
    return decoding.latent_states(own, t, c.window, c.latent_dim, c.target_shifts, gap=config.gap, edges=edges.select(unit, "fold", "start", "stop", "gap"), **options)


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def manifest(spark: SparkSession, tables: dict[str, DataFrame], config: EvaluationConfig) -> str:
    """JSON with the configuration, each table's columns and rows, and how many fits there are and how many of them ended by their own rule."""
    fits = tables["models"].groupBy(*KEYS, "spec").agg(F.bool_and("converged").alias("converged")).groupBy("converged").count().collect()
    ended = {r["converged"]: r["count"] for r in fits}
    return json.dumps({"config": asdict(config), "fits": {"all": sum(ended.values()), "converged": ended.get(True, 0)}, "tables": {n: {"columns": d.columns, "rows": d.count()} for n, d in sorted(tables.items())}, "spark": spark.version}, sort_keys=True, default=str)
