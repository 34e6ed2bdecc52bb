"""Sums of lagged products of multichannel series over chunks of frames: cross-covariances, moments of stacked lags, VAR and partial correlations.

A chunk of frames carries the last frames of the chunk before it (a halo), so every pair of frames meets in one task whose size doesn't depend on the
length of a recording; chunks' sums are added up. Pairs never reach over a gap of time_index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_divide
from .bss import _types

REC = ("recording",)
#: Frames of a chunk. A chunk's sums have a row for each pair of series and lag, so chunks shouldn't hold fewer frames than there are series.
CHUNK = 4096


def with_halo(wide: DataFrame, halo: int, chunk: int = CHUNK) -> DataFrame:
    """Rows with the number of their chunk of `chunk` frames, once more in each later chunk that starts within `halo` frames."""
    at = lambda t: F.floor(t / F.lit(chunk))
    return wide.withColumn("_chunk", F.explode(F.sequence(at(F.col("time_index")), at(F.col("time_index") + halo))))


def standardized(wide: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """x of each series less its mean, over its population deviation; a deviation of 0 counts as 1."""
    each = wide.select(*keys, F.posexplode("x").alias("neuron", "value"))
    fit = each.groupBy(*keys, "neuron").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    fit = fit.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("neuron", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std")))).alias("_fit"))
    z = F.zip_with("x", "_fit", lambda v, f: (v - f["mean"]) / f["std"])
    return wide.join(fit, list(keys)).withColumn("x", z).drop("_fit")


def _own_frames(own: pd.DataFrame, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of a chunk with its halo: x in order of time, the run of consecutive frames that each is in, and which are the chunk's own."""
    own = own.sort_values("time_index", kind="stable")
    t = own["time_index"].to_numpy(np.int64)
    return np.stack(own["x"].to_list()).astype(float), np.cumsum(np.diff(t, prepend=t[0]) != 1), t >= int(own["_chunk"].iloc[0]) * chunk


def lagged_products(wide: DataFrame, lags: Sequence[int], keys: Sequence[str] = REC, chunk: int = CHUNK) -> DataFrame:
    """keys, lag, source, target, product (sum over frames of the source `lag` frames earlier times the target) and n, the number of such frames."""
    if min(lags, default=0) < 0:
        raise ValueError("lags must not be negative")

    def sums(own: pd.DataFrame) -> pd.DataFrame:
        x, run, mine = _own_frames(own, chunk)
        d, parts = x.shape[1], []
        source, target = (v.ravel() for v in np.meshgrid(np.arange(d), np.arange(d), indexing="ij"))
        for lag in dict.fromkeys(lags):
            at = np.flatnonzero(mine)
            at = at[at >= lag]
            at = at[run[at - lag] == run[at]]
            parts.append(pd.DataFrame({k: [own[k].iloc[0]] * d * d for k in keys} | {"lag": lag, "source": source, "target": target, "product": (x[at - lag].T @ x[at]).ravel(), "n": len(at)}))
        return pd.concat(parts)

    cells = with_halo(wide.select(*keys, "time_index", "x"), max(lags), chunk).groupBy(*keys, "_chunk").applyInPandas(sums, f"{_types(wide, keys)}, lag int, source int, target int, product double, n long")
    return cells.groupBy(*keys, "lag", "source", "target").agg(F.sum("product").alias("product"), F.sum("n").alias("n"))


def cross_correlations(wide: DataFrame, lags: Sequence[int], keys: Sequence[str] = REC, chunk: int = CHUNK) -> DataFrame:
    """keys, lag, source, target and the mean product r of the standardized series; NULL where no pair of frames is that far apart."""
    sums = lagged_products(standardized(wide, keys), lags, keys, chunk)
    return sums.select(*keys, "lag", "source", "target", safe_divide("product", "n").alias("r"))


def temporal_dependence_change(variants: DataFrame, lags: Sequence[int], reference: str = "raw", keys: Sequence[str] = REC, chunk: int = CHUNK) -> DataFrame:
    """For each variant (wide) and lag: the relative change (Frobenius norm) of all cross-correlations from the reference's, and the median
    absolute change of the autocorrelations. The relative change is NULL where the reference has none.
    """
    r = cross_correlations(variants, lags, [*keys, "variant"], chunk)
    ref = r.filter(F.col("variant") == reference).select(*keys, "lag", "source", "target", F.col("r").alias("_ref"))
    met = r.join(ref, [*keys, "lag", "source", "target"])
    moved = F.col("r") - F.col("_ref")
    own = F.when(F.col("source") == F.col("target"), F.abs(moved))
    norm = F.sqrt(F.sum(F.col("_ref") * F.col("_ref")))
    return met.groupBy(*keys, "variant", "lag").agg(F.when(norm > 0, F.sqrt(F.sum(moved * moved)) / norm).alias("xcf_relative_change"), F.percentile(own, F.lit(0.5)).alias("acf_change_median"))


def lagged_covariances(wide: DataFrame, lags: Sequence[int], keys: Sequence[str] = REC, chunk: int = CHUNK) -> DataFrame:
    """Symmetrized covariances of centered series at each lag, over pairs inside runs of frames: what second-order separation diagonalizes."""
    c = lagged_products(wide, lags, keys, chunk).select(*keys, "lag", "source", "target", "product", "n")
    turned = c.select(*keys, "lag", F.col("source").alias("target"), F.col("target").alias("source"), F.col("product").alias("_turned"))
    return c.join(turned, [*keys, "lag", "source", "target"]).filter("n > 0").select(*keys, "lag", "source", "target", ((F.col("product") + F.col("_turned")) / (2 * F.col("n"))).alias("covariance"))


def stacked_moments(wide: DataFrame, depth: int, keys: Sequence[str] = REC, pool: Sequence[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Sums of products of [x, x one frame earlier, ..., x depth frames earlier, 1] over the frames that have them all: keys, row <= column, value.

    Series number s at lag k is lag * series + s; the last is the constant, so value of the last row and column is the number of frames. With
    `pool`, a part of the keys, sums run over all panels of a pool; lags never reach from one panel into another.
    """
    pool = list(keys if pool is None else pool)

    def sums(own: pd.DataFrame) -> pd.DataFrame:
        x, run, mine = _own_frames(own, chunk)
        at = np.flatnonzero(mine)
        at = at[at >= depth]
        at = at[run[at - depth] == run[at]]
        rows = np.column_stack([*(x[at - k] for k in range(depth + 1)), np.ones(len(at))])
        total = rows.T @ rows
        i, j = np.triu_indices(len(total))
        return pd.DataFrame({k: [own[k].iloc[0]] * len(i) for k in pool} | {"row": i, "column": j, "value": total[i, j]})

    cells = with_halo(wide.select(*keys, "time_index", "x"), depth, chunk).groupBy(*keys, "_chunk").applyInPandas(sums, f"{_types(wide, pool)}, row int, column int, value double")
    return cells.groupBy(*pool, "row", "column").agg(F.sum("value").alias("value"))


def square(raw: bytes) -> np.ndarray:
    """The matrix of stacked_correlations."""
    values = np.frombuffer(raw)
    return values.reshape(-1, round(len(values) ** 0.5))


def _matrix(own: pd.DataFrame) -> np.ndarray:
    i, j = own["row"].to_numpy(), own["column"].to_numpy()
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = out[j, i] = own["value"].to_numpy()
    return out


def stacked_correlations(wide: DataFrame, depth: int, keys: Sequence[str] = REC, pool: Sequence[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each pool: series, n and the correlation matrix of all series at lags 0 .. depth as binary doubles; constant series correlate with none."""
    pool = list(keys if pool is None else pool)

    def one(own: pd.DataFrame) -> pd.DataFrame:
        total = _matrix(own)
        n = total[-1, -1]
        mean = total[:-1, -1] / max(n, 1)
        c = total[:-1, :-1] / max(n, 1) - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(c), 0))
        std = np.where(std > 1e-12, std, np.inf)
        c = c / np.outer(std, std)
        np.fill_diagonal(c, 1.0)
        return pd.DataFrame({k: [own[k].iloc[0]] for k in pool} | {"series": [len(c) // (depth + 1)], "n": [int(n)], "matrix": [c.tobytes()]})

    moments = stacked_moments(standardized(wide, pool), depth, keys, pool, chunk)
    return moments.groupBy(*pool).applyInPandas(one, f"{_types(wide, pool)}, series int, n long, matrix binary")


def var_coefficients(wide: DataFrame, depth: int, keys: Sequence[str] = REC, chunk: int = CHUNK) -> DataFrame:
    """keys, lag (1 .. depth), source, target and the least-squares coefficient of the present on the last `depth` frames, from normal equations."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        total = _matrix(own)
        d = (len(total) - 1) // (depth + 1)
        past = total[d:-1, d:-1]
        scale = np.sqrt(np.maximum(np.diag(past), 1e-300))  # of equal size, so that rounding doesn't depend on units
        b = np.linalg.lstsq(past / np.outer(scale, scale), total[d:-1, :d] / scale[:, None], rcond=None)[0] / scale[:, None]
        lag, source, target = (v.ravel() for v in np.meshgrid(np.arange(1, depth + 1), np.arange(d), np.arange(d), indexing="ij"))
        return pd.DataFrame({k: [own[k].iloc[0]] * b.size for k in keys} | {"lag": lag, "source": source, "target": target, "coefficient": b.ravel()})

    return stacked_moments(wide, depth, keys, chunk=chunk).groupBy(*keys).applyInPandas(solve, f"{_types(wide, keys)}, lag int, source int, target int, coefficient double")


def partial_correlations(correlations: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """keys, row, column and the partial correlation of each pair of stacked series given all others, from one inverse of stacked_correlations."""

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own in batch.to_dict("records"):
                c = square(own["matrix"])
                p = np.linalg.pinv(c, hermitian=True)
                i, j = np.triu_indices(len(c), 1)
                yield pd.DataFrame({k: [own[k]] * len(i) for k in keys} | {"row": i, "column": j, "r": -p[i, j] / np.sqrt(p[i, i] * p[j, j])})

    return correlations.mapInPandas(invert, f"{_types(correlations, keys)}, row int, column int, r double")
