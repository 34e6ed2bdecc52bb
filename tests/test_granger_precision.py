import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.kernels import granger
from tracewright.operators import graphs


def regressed(x, depth, method, draws, seed):
    """Each pair's residuals by a regression of its own."""
    d, rows = x.shape[1], granger.stacked_lags(x, depth)
    out = {}
    for s in range(d):
        for lag in range(depth + 1):
            for t in range(d):
                i = lag * d + s
                if i == t:
                    continue
                drop = {i, t} | ({s + k * d for k in range(lag)} if method == "cgc" else set())
                r = granger._residuals(rows[[i, t]], np.delete(rows, sorted(drop), axis=0))
                c, p = granger.shift_pvalues(r[:1], r[1:], draws, seed + 1)
                out[s, lag, t] = c[0], p[0]
    return out


@pytest.mark.parametrize("method", ["cgc", "fcgc"])
def test_one_inverse_gives_every_regression(method):
    r = np.random.default_rng(4)
    x = np.cumsum(r.normal(size=(160, 4)), axis=0) * [1, 1e4, 1e-3, 1] + 7
    got = granger.dependence(x, 3, method, 50, 1)
    want = regressed(x, 3, method, 50, 1)
    for s, lag, t, c, p in zip(*(got[k] for k in ("source", "lag", "target", "inv_corr", "inv_p")), strict=True):
        if (s, lag, t) in want:
            assert c == pytest.approx(want[s, lag, t][0], abs=1e-8) and p == pytest.approx(want[s, lag, t][1], abs=0.03)


def test_dependent_series_are_regressed_one_by_one():
    x = np.random.default_rng(5).normal(size=(80, 3))
    x[:, 2] = x[:, 0] - x[:, 1]
    got = granger.dependence(x, 1, "fcgc", 20, 0)
    assert np.isfinite(got["inv_corr"]).all()
    want = regressed(x, 1, "fcgc", 20, 0)
    assert np.allclose([c for s, lag, t, c in zip(got["source"], got["lag"], got["target"], got["inv_corr"], strict=True) if (s, lag, t) in want], [v[0] for v in want.values()])


def test_a_hundred_series_take_seconds():
    x = np.random.default_rng(6).normal(size=(1500, 100))
    began = time.perf_counter()
    got = granger.dependence(x, 5, "cgc", 100, 0, sources=range(16))
    assert len(got["corr"]) == 16 * 6 * 100 and time.perf_counter() - began < 60


def test_blocks_of_sources_are_the_whole(spark):
    x = np.random.default_rng(7).normal(size=(60, 5))
    df = spark.createDataFrame([(0, t, [float(v) for v in row]) for t, row in enumerate(x)], "recording int, time_index int, x array<double>")
    whole = {tuple(r) for r in graphs.dependence_tests(df, [1, 2], draws=30, block=5).collect()}
    parts = {tuple(r) for r in graphs.dependence_tests(df, [1, 2], draws=30, block=2).collect()}
    key = lambda rows: sorted((r[:5], tuple(round(v, 9) for v in r[5:])) for r in rows)
    assert key(whole) == key(parts) and len(whole) == 5 * 5 * (2 + 3)


def test_recovery_counts_units_without_edges(spark):
    predicted = spark.createDataFrame([(0, 1, 0, 1, 0.5), (0, 1, 1, 2, 0.5), (1, 1, 0, 0, 0.5)], "recording int, depth int, source int, target int, weight double")
    truth = spark.createDataFrame([(0, 1), (2, 0)], "source int, target int")
    got = {r["recording"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in graphs.recovery(predicted, truth, 3).orderBy(F.col("recording")).collect()}
    assert got == {0: (1, 1, 1, 3), 1: (0, 0, 2, 4)}
