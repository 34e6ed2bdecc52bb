"""Cross-validated ridge decoding of recordings of any length, from sums over chunks of frames.

A chunk's sums of products of features and targets are made once for all its frames, and once more for those frames that a fold may not train on; a
fold's normal equations are the total less these. So the frames are read once to fit, whatever the number of folds, and once to predict, and the
fits themselves only see sums. Predictions are those of decode(), which holds a variant in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved
from .bss import _names, _nothing, _types
from .lagged import CHUNK, _own_frames, with_halo


def _design(own: pd.DataFrame, lags: Sequence[int], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a chunk's frames that have all lags (x at each lag side by side), and the places of these frames in order of time."""
    x, run, mine = _own_frames(own, chunk)
    at = np.flatnonzero(mine)
    at = at[at >= max(lags)]
    at = at[run[at - max(lags)] == run[at]]
    return np.concatenate([x[at - lag] for lag in lags], axis=1), at


def _roles(time: np.ndarray, fold: Sequence[int], lags: Sequence[int], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Which frames a fold (number, start, stop, gap) trains on and tests: all their features and their target on one side."""
    _, start, stop, gap = fold
    train = lambda t: (t < start - gap) | (t >= stop + gap)
    lagged = np.stack([train(time - lag) for lag in lags])
    ahead = time + shift
    return train(ahead) & lagged.all(axis=0), (ahead >= start) & (ahead < stop) & ~lagged.any(axis=0)


def ridge_by_folds(
    variants: DataFrame, targets: DataFrame, edges: DataFrame, columns: Sequence[str], lags: Sequence[int] = (0, 1, 2), shift: int = 0, alpha: float = 10.0, transfer: bool = True, reference: str = "raw",
    chunk: int = CHUNK,
) -> DataFrame:
    """Out-of-fold predictions of continuous targets: recording, target, comparison (within, transfer_raw_to_clean or transfer_clean_to_raw),
    train_version, test_version, fold, n_train, time_index, y_true and y_pred.

    variants(recording, variant, time_index, x), targets(recording, time_index, columns), edges(recording, fold, start, stop, gap). Features are scaled
    by a fold's training frames. Frames without a target take no part; lags don't reach over gaps of time.
    """
    lags = sorted(set(lags))
    rows = variants.select("recording", "variant", "time_index", "x")
    each = rows.filter(F.col("variant") == reference).select("recording", F.posexplode("x").alias("neuron", "v"))
    center = each.groupBy("recording", "neuron").agg(F.avg("v").alias("m")).groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("neuron", "m"))).alias("_center"))
    # any shift common to train and test leaves predictions as they are; this one keeps sums of products small
    rows = rows.join(center, "recording").withColumn("x", F.zip_with("x", "_center", lambda v, c: v - c["m"])).drop("_center")
    ys = targets.select("recording", (F.col("time_index") - shift).alias("time_index"), F.array(*(F.col(c).cast("double") for c in columns)).alias("ys"))
    folds = edges.groupBy("recording").agg(F.sort_array(F.collect_list(F.array("fold", "start", "stop", "gap"))).alias("edges"))
    rows = rows.join(ys, ["recording", "time_index"], "left").join(folds, "recording")
    pieces = with_halo(rows, max(lags), chunk)
    p_keys = ["recording", "variant"]

    def usable(own: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        own = own.sort_values("time_index", kind="stable")
        a, at = _design(own, lags, chunk)
        y = np.array([own["ys"].iloc[i] if own["ys"].iloc[i] is not None else [np.nan] * len(columns) for i in at], float).reshape(len(at), len(columns))
        known = ~np.isnan(y).any(axis=1)
        return own, a[known], y[known], own["time_index"].to_numpy(np.int64)[at[known]]

    def sums(own: pd.DataFrame) -> pd.DataFrame:
        own, a, y, time = usable(own)
        left, right = np.column_stack([a, np.ones(len(a))]), np.column_stack([a, np.ones(len(a)), y])
        out = []
        for fold in [None, *own["edges"].iloc[0]]:
            use = np.ones(len(a), bool) if fold is None else ~_roles(time, fold, lags, shift)[0]
            if use.any():
                total = left[use].T @ right[use]
                i, j = (v.ravel() for v in np.meshgrid(*map(np.arange, total.shape), indexing="ij"))
                out.append(pd.DataFrame({k: [own[k].iloc[0]] * total.size for k in p_keys} | {"fold": -1 if fold is None else int(fold[0]), "row": i, "column": j, "value": total.ravel()}))
        return pd.concat(out) if out else _nothing([*p_keys, "fold", "row", "column", "value"])

    cells = pieces.groupBy(*p_keys, "_chunk").applyInPandas(sums, f"{_types(rows, p_keys)}, fold int, row int, column int, value double")
    cells = cells.groupBy(*p_keys, "fold", "row", "column").agg(F.sum("value").alias("value")).join(folds, "recording")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        size = int(own["row"].max()) + 1
        total, out = {}, []
        for fold, part in own.groupby("fold"):
            total[fold] = np.zeros((size, size + len(columns)))
            total[fold][part["row"], part["column"]] = part["value"]
        for number, *_ in own["edges"].iloc[0]:
            s = total[-1] - total.get(number, 0.0)
            n = s[-1, size - 1]
            if n < 2:
                continue
            mean, of_y = s[:-1, size - 1] / n, s[-1, size:] / n
            c = s[:-1, : size - 1] - n * np.outer(mean, mean)
            varies = np.diag(c) > 1e-12 * np.diag(s)[: size - 1]  # of a constant feature the sums only leave rounding
            std = np.sqrt(np.where(varies, np.diag(c) / n, 1.0))
            w = np.linalg.solve(c / np.outer(std, std) + alpha * np.eye(len(c)), (s[:-1, size:] - n * np.outer(mean, of_y)) / std[:, None]) / std[:, None]
            out.append({k: own[k].iloc[0] for k in p_keys} | {"fold": int(number), "n_train": int(n), "weights": w.ravel().tolist(), "intercepts": (of_y - mean @ w).tolist()})
        return pd.DataFrame(out, columns=[*p_keys, "fold", "n_train", "weights", "intercepts"])

    models = saved(cells.groupBy(*p_keys).applyInPandas(fit, f"{_types(rows, p_keys)}, fold int, n_train long, weights array<double>, intercepts array<double>"), "ridge-models")
    trained = models.withColumnRenamed("variant", "train_version")
    uses = trained.select("*", F.col("train_version").alias("variant"), F.lit("within").alias("comparison"))
    if transfer:
        names = rows.select("recording", "variant").distinct().filter(F.col("variant") != reference)
        uses = uses.unionByName(trained.filter(F.col("train_version") == reference).join(names, "recording").withColumn("comparison", F.lit("transfer_raw_to_clean")))
        uses = uses.unionByName(trained.filter(F.col("train_version") != reference).select("*", F.lit(reference).alias("variant"), F.lit("transfer_clean_to_raw").alias("comparison")))
    # a chunk only gets the models of folds that test some of its frames
    spans = edges.select("recording", "fold", F.explode(F.sequence(F.floor((F.col("start") - shift) / chunk), F.floor((F.col("stop") - 1 - shift) / chunk))).alias("_chunk"))
    uses = uses.join(spans, ["recording", "fold"])

    def predict(own: pd.DataFrame, use: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(use):
            own, a, y, time = usable(own)
            of_fold = {int(f[0]): f for f in own["edges"].iloc[0]}
            for r in use.itertuples():
                test = _roles(time, of_fold[r.fold], lags, shift)[1]
                if test.any():
                    f = a[test] @ np.reshape(r.weights, (a.shape[1], len(columns))) + np.array(r.intercepts)
                    for k, name in enumerate(columns):
                        same = {"recording": r.recording, "target": name, "comparison": r.comparison, "train_version": r.train_version, "test_version": r.variant, "fold": r.fold, "n_train": r.n_train}
                        out.append(pd.DataFrame(same | {"time_index": time[test], "y_true": y[test, k], "y_pred": f[:, k]}))
        return pd.concat(out) if out else _nothing(_names(schema))

    schema = f"{_types(rows, ['recording'])}, target string, comparison string, train_version string, test_version string, fold int, n_train long, time_index int, y_true double, y_pred double"
    keys = [*p_keys, "_chunk"]
    return pieces.groupBy(*keys).cogroup(uses.groupBy(*keys)).applyInPandas(predict, schema)
