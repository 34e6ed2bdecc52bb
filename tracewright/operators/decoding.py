"""Leakage-safe decoding and latent-state experiments: the grid of jobs is the axis of parallelism, kernels return out-of-fold rows, and all
metrics are aggregates over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pearson, r_squared, rmse, safe_divide
from ..kernels import models
from ..kernels.bss import principal_axes
from ..kernels.draws import null_order
from .bss import _names, _nothing, _types
from .folds import fold_edges
from .metrics import classification_metrics, regression_metrics

JOB = ("recording", "target", "comparison", "train_version", "test_version", "null_strategy", "null_seed", "null_block_size", "fold")


@dataclass(frozen=True)
class Target:
    """A column of the targets to decode: its values, or with a quantile whether they reach it over a fold's training frames."""

    name: str
    column: str
    quantile: float | None = None


@dataclass(frozen=True)
class Null:
    """Training targets in an order of draws.null_order; the size of blocks only counts for block_shuffle."""

    strategy: str
    seed: int
    block_size: int | None = None


def _lagged(x: np.ndarray, lags: Sequence[int], t: np.ndarray) -> np.ndarray:
    return np.concatenate([x[t - lag] for lag in lags], axis=1)


def _predicted(a: np.ndarray, y: np.ndarray, b: np.ndarray, states: bool, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and scores of rows b by a ridge, or for states by a balanced logistic regression, of y on a."""
    score = np.full(len(b), np.nan)
    if not states:
        w, c = models.ridge(a, y, alpha)
        return b @ w + c, score
    if (w := models.balanced_logistic(a, y)) is None:
        return np.full(len(b), y[0]), score
    score = models.logistic_score(w, b)
    return (score > 0.5).astype(float), score


def decode(
    variants: DataFrame, targets: DataFrame, edges: DataFrame, wanted: Sequence[Target], lags: Sequence[int] = (0, 1, 2), shift: int = 0, alpha: float = 10.0,
    transfer: bool = True, nulls: Sequence[Null] = (), null_min_shift: int = 60, reference: str = "raw",
) -> DataFrame:
    """Out-of-fold predictions of every target: within each variant, from the reference to each other variant and back, and of null targets on
    the reference. A variant is shuffled once with the reference beside it; folds, targets and nulls are loops over its matrix. A variant with
    frames that the reference lacks takes part within itself only.

    Training rows use no frame outside the training blocks, test rows none inside them.
    """
    lags, columns = sorted(set(lags)), list(dict.fromkeys(t.column for t in wanted))
    at, is_reference = ["recording", "time_index"], F.col("variant") == reference
    rows = variants.select("recording", "variant", "time_index", "x")
    if transfer:
        raw = rows.filter(is_reference).select(*at, F.col("x").alias("raw"))
        own = rows.filter(is_reference).withColumn("raw", F.lit(None).cast(raw.schema["raw"].dataType))
        rows = own.unionByName(rows.filter(~is_reference).join(raw, at, "left"))
    ys = targets.select(*at, F.array(*(F.col(c).cast("double") for c in columns)).alias("ys"))
    of_recording = edges.groupBy("recording").agg(F.sort_array(F.collect_list(F.array("fold", "start", "stop", "gap"))).alias("edges"))
    rows = rows.join(ys, at).join(of_recording, "recording")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("time_index", kind="stable")
        name, time, n = own["variant"].iloc[0], own["time_index"].to_numpy(), len(own)
        x, y_of = np.stack(own["x"].to_list()), dict(zip(columns, np.stack(own["ys"].to_list()).astype(float).T, strict=True))
        raw = np.stack(own["raw"].to_list()) if transfer and name != reference and own["raw"].notna().all() else None
        pairs = [("within", name, name, x, x)]
        if raw is not None:
            pairs += [("transfer_raw_to_clean", reference, name, raw, x), ("transfer_clean_to_raw", name, reference, x, raw)]
        frame, t, out = np.arange(n), np.arange(max(lags), n - shift), []
        for fold, start, stop, gap in own["edges"].iloc[0]:
            train_frame = (frame < start - gap) | (frame >= stop + gap)
            test_frame = (frame >= start) & (frame < stop)
            lagged = np.stack([train_frame[t - lag] for lag in lags])
            train, test = t[train_frame[t + shift] & lagged.all(axis=0)], t[test_frame[t + shift] & ~lagged.any(axis=0)]
            if len(train) < 2 or not len(test):
                continue
            for comparison, fitted_on, tested_on, xa, xb in pairs:
                a, b = _lagged(xa, lags, train), _lagged(xb, lags, test)
                mean, std = models.standardizer(a)
                a, b = (a - mean) / std, (b - mean) / std
                for target in wanted:
                    y, states = y_of[target.column], target.quantile is not None
                    if states:
                        y = (y >= np.quantile(y[train_frame], target.quantile)).astype(float)
                    known = y[train + shift]
                    for null in (None, *(nulls if name == reference else ())):
                        drawn = known if null is None else known[null_order(train, null.strategy, null.seed, null.block_size or 1, null_min_shift)]
                        predicted, score = _predicted(a, drawn, b, states, alpha)
                        kind = (comparison, None, None, None) if null is None else ("null_within", null.strategy, null.seed, null.block_size)
                        out.append((own["recording"].iloc[0], target.name, kind[0], fitted_on, tested_on, *kind[1:], fold, len(train), time[test], y[test + shift], predicted, score))
        return pd.DataFrame(out, columns=[*JOB, "n_train", "time_index", "y_true", "y_pred", "y_score"])

    vectors = ["time_index", "y_true", "y_pred", "y_score"]
    schema = (
        f"{_types(rows, ['recording'])}, target string, comparison string, train_version string, test_version string, null_strategy string, null_seed int, null_block_size int, fold int, n_train int, "
        "time_index array<int>, y_true array<double>, y_pred array<double>, y_score array<double>"
    )
    out = rows.groupBy("recording", "variant").applyInPandas(run, schema)
    out = out.select(*JOB, "n_train", F.explode(F.arrays_zip(*vectors)).alias("_r")).select(*JOB, "n_train", "_r.*")
    return out.withColumn("y_score", F.nanvl("y_score", F.lit(None)))


def decoding_metrics(predictions: DataFrame, task: str) -> DataFrame:
    if task == "regression":
        return regression_metrics(predictions, "y_true", "y_pred", JOB)
    return classification_metrics(predictions, "y_true", "y_pred", JOB, "y_score")


def run_decoding(
    variants: DataFrame, targets: DataFrame, task: str, n_splits: int = 5, gap: int = 14, transfer: bool = True, nulls: Sequence[tuple[str, int]] = (), lags: Sequence[int] = (0, 1, 2), shift: int = 0,
    alpha: float = 10.0, bout_quantile: float = 0.75, null_block: int = 60, null_min_shift: int = 60,
) -> DataFrame:
    """decode() of one target, y, over equal contiguous folds of the variant raw."""
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task {task!r}")
    edges = fold_edges(variants.filter("variant = 'raw'"), n_splits, gap, required_gap=max(max(lags), shift))
    drawn = [Null(strategy, seed, null_block if strategy == "block_shuffle" else None) for strategy, seed in nulls]
    return decode(variants, targets, edges, [Target("y", "y", None if task == "regression" else bout_quantile)], lags, shift, alpha, transfer, drawn, null_min_shift)


CAUSAL = ("recording", "variant", "fold", "transition", "target_shift")


def latent_states(
    variants: DataFrame, targets: DataFrame, window: int = 10, latent_dim: int = 3, shift: int | Sequence[int] = 1, n_splits: int = 5, gap: int = 14, alpha: float = 10.0, bout_quantile: float = 0.75,
    transitions: Sequence[str] = ("linear",), seed: int = 0, hidden: int = 16, rounds: int = 500, edges: DataFrame | None = None,
) -> DataFrame:
    """Test rows of the latent-state model: z of the history, z of the next one as seen and as predicted, the training mean, heads for angle,
    vigor and bout state `shift` frames ahead (each of several shifts), and vigor and angle from z alone and from z with its history.

    targets(recording, time_index, angle, vigor). Everything is fitted on windows that lie in the training blocks: of equal folds of the variant
    raw, or of edges(recording, fold, start, stop, gap). Each variant is shuffled once for each fold; shifts and transitions are loops, and transitions share a fit of the axes.
    """
    if window < 2 or latent_dim < 1 or not 0 <= bout_quantile <= 1:
        raise ValueError("window >= 2, latent_dim >= 1 and a quantile are needed")
    if gap < window - 1:
        raise ValueError(f"gap {gap} is under the required {window - 1}")
    if bad := set(transitions) - {"linear", "mlp"}:
        raise ValueError(f"unknown transition models {sorted(bad)}")
    edges = fold_edges(variants.filter("variant = 'raw'"), n_splits, gap) if edges is None else edges.select("recording", "fold", "start", "stop", "gap")
    jobs = variants.join(targets.select("recording", "time_index", "angle", "vigor"), ["recording", "time_index"]).join(edges, ["recording"])
    shifts = [shift] if isinstance(shift, int) else list(dict.fromkeys(shift))
    types = f"{_types(jobs, ['recording', 'variant', 'fold'])}, transition string, target_shift int"
    vector = "array<double>"
    schema = f"{types}, time_index int, z {vector}, z_next {vector}, z_predicted {vector}, z_mean {vector}, angle double, angle_pred double, vigor double, vigor_pred double, bout_state int, bout_pred int, bout_score double, vigor_from_z double, vigor_from_history double, angle_from_z double, angle_from_history double, converged boolean"

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("time_index", kind="stable")
        parts = [part for shift in shifts for part in of_shift(own, shift)]
        return pd.concat(parts) if parts else _nothing(_names(schema))

    def of_shift(own: pd.DataFrame, shift: int) -> Iterator[pd.DataFrame]:
        first = own.iloc[0]
        x, angle, vigor = np.stack(own["x"].to_list()), own["angle"].to_numpy(float), own["vigor"].to_numpy(float)
        n, start, stop, g = len(own), int(first["start"]), int(first["stop"]), int(first["gap"])
        frame = np.arange(n)
        train_frame, test_frame = (frame < start - g) | (frame >= stop + g), (frame >= start) & (frame < stop)
        t = np.arange(window - 2, n - max(1, shift))
        span = np.stack([train_frame[t + o] for o in range(-(window - 2), 2)])
        train = t[span.all(axis=0) & train_frame[t + shift]]
        test = t[~span.any(axis=0) & test_frame[t] & test_frame[t + shift]]
        if len(train) <= latent_dim or not len(test):
            return
        flat = lambda at: np.concatenate([x[at - o] for o in range(window - 2, -1, -1)], axis=1)
        mean, std = models.standardizer(flat(train))
        center, _, axes = principal_axes((flat(train) - mean) / std)
        code = lambda at: ((flat(at) - mean) / std - center) @ axes[:latent_dim].T
        z_train, z_test, ahead_train, ahead_test = code(train), code(test), code(train + 1), code(test + 1)
        head = lambda y: (lambda m: z_test @ m[0] + m[1])(models.ridge(z_train, y[train + shift], alpha))
        bout = (vigor >= np.quantile(vigor[train + shift], bout_quantile)).astype(int)
        model = models.balanced_logistic(z_train, bout[train + shift])
        score = np.full(len(test), np.nan) if model is None else models.logistic_score(model, z_test)
        state = np.full(len(test), bout[train[0] + shift]) if model is None else (score > 0.5).astype(int)
        with_history = lambda at, z: np.concatenate([z, (flat(at) - mean) / std], axis=1)
        both = models.ridge(with_history(train, z_train), np.stack([vigor, angle], axis=1)[train + shift], alpha)
        of_history = with_history(test, z_test) @ both[0] + both[1]
        of_angle, of_vigor = head(angle), head(vigor)
        for transition in transitions:
            converged = True
            if transition == "linear":
                w, c = models.ridge(z_train, ahead_train - z_train, alpha)
                moved = z_test + z_test @ w + c
            else:
                net = models.SmallNetwork(hidden, seed, rounds).fit(z_train, ahead_train - z_train)
                moved, converged = z_test + net.predict(z_test), net.converged
            yield pd.DataFrame(
                {k: [first[k]] * len(test) for k in ("recording", "variant", "fold")} | {
                    "transition": transition, "target_shift": shift,
                    "time_index": own["time_index"].to_numpy()[test], "z": list(z_test), "z_next": list(ahead_test), "z_predicted": list(moved), "z_mean": [ahead_train.mean(axis=0)] * len(test),
                    "angle": angle[test + shift], "angle_pred": of_angle, "vigor": vigor[test + shift], "vigor_pred": of_vigor, "bout_state": bout[test + shift], "bout_pred": state, "bout_score": score,
                    "vigor_from_z": of_vigor, "vigor_from_history": of_history[:, 0], "angle_from_z": of_angle, "angle_from_history": of_history[:, 1], "converged": converged,
                }
            )

    return jobs.groupBy("recording", "variant", "fold").applyInPandas(run, schema).withColumn("bout_score", F.nanvl("bout_score", F.lit(None)))


def _mean_square(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def latent_metrics(rows: DataFrame) -> DataFrame:
    """Prediction errors of the latent state against persistence and the mean state, heads' quality and residual links, of each fold."""
    spread = rows.select(*CAUSAL, F.posexplode("z_next").alias("i", "v")).groupBy(*CAUSAL, "i").agg(F.var_pop("v").alias("v")).groupBy(*CAUSAL).agg(F.avg("v").alias("held_out_latent_variance"))
    own = rows.withColumn("_res", F.sqrt(_mean_square("z_next", "z_predicted") * F.size("z")))
    out = own.groupBy(*CAUSAL).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(_mean_square("z_next", "z_predicted")).alias("dynamic_mse"), F.avg(_mean_square("z_next", "z")).alias("persistence_mse"), F.avg(_mean_square("z_next", "z_mean")).alias("mean_state_mse"),
        r_squared("angle", "angle_pred").alias("angle_r2"), pearson("angle", "angle_pred").alias("angle_pearson"), r_squared("vigor", "vigor_pred").alias("vigor_r2"), pearson("vigor", "vigor_pred").alias("vigor_pearson"),
        pearson("_res", "vigor").alias("residual_vigor_corr"), pearson("_res", F.col("bout_state").cast("double")).alias("residual_bout_corr"), F.bool_and("converged").alias("converged"),
    )
    bouts = classification_metrics(rows, "bout_state", "bout_pred", CAUSAL, "bout_score").select(*CAUSAL, F.col("balanced_accuracy").alias("bout_balanced_accuracy"), F.col("roc_auc").alias("bout_roc_auc"))
    out = out.join(spread, list(CAUSAL)).join(bouts, list(CAUSAL))
    return out.withColumns({"dynamic_mse_normalized": safe_divide("dynamic_mse", F.when(F.col("held_out_latent_variance") > 0, F.col("held_out_latent_variance"))), "dynamic_improvement_vs_persistence": 1 - safe_divide("dynamic_mse", F.when(F.col("persistence_mse") > 0, F.col("persistence_mse")))})


def markov_sufficiency(rows: DataFrame, target: str = "vigor") -> DataFrame:
    """Error of the coming vigor or angle from the latent state alone and with its history; a ratio near 1 means that the state suffices."""
    if target not in ("vigor", "angle"):
        raise ValueError(f"unknown sufficiency target {target!r}")
    out = rows.groupBy(*CAUSAL).agg(rmse(target, f"{target}_from_z").alias("rmse_z"), rmse(target, f"{target}_from_history").alias("rmse_z_history"))
    return out.withColumn("sufficiency_ratio", safe_divide("rmse_z_history", "rmse_z"))


def ridge_from_sums(rows: DataFrame, x: str, y: str, alpha: float, keys: Sequence[str]) -> DataFrame:
    """Slope and intercept of a one-feature ridge from aggregated sums: no row leaves its partition unsummed."""
    n = F.count(F.lit(1))
    slope = F.covar_pop(x, y) * n / (F.var_pop(x) * n + alpha)
    return rows.groupBy(*keys).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), n.alias("n"))
