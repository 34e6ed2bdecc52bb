import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.kernels import granger, pcmci
from tracewright.operators import causal, lagged


def frames(spark, x, recording=0, start=0):
    return spark.createDataFrame([(recording, start + t, [float(v) for v in row]) for t, row in enumerate(x)], "recording int, time_index int, x array<double>")


def series(n=1500, seed=0, contemporaneous=((1, 2, 0.6), (3, 2, 0.5)), lagged_links=((0, 1, 1, 0.5), (3, 2, 0, 0.4)), d=4, noise=None):
    """Autocorrelated series with the given links: (source, lag, target, weight) and, in order of the present, (source, target, weight)."""
    r = np.random.default_rng(seed)
    e = r.normal(size=(n + 50, d)) if noise is None else noise
    x = np.zeros_like(e)
    for t in range(3, len(x)):
        x[t] = e[t] + 0.5 * x[t - 1]
        for s, lag, j, w in lagged_links:
            x[t, j] += w * x[t - lag, s]
        for s, j, w in contemporaneous:
            x[t, j] += w * x[t, s]
    return x[50:]


def edges(rows):
    return {(r["source"], r["lag"], r["target"], r["mark"]) for r in rows if r["mark"] != "<--"}


TRUE = {(j, 1, j, "-->") for j in range(4)} | {(0, 1, 1, "-->"), (3, 2, 0, "-->"), (1, 0, 2, "-->"), (3, 0, 2, "-->")}


@pytest.mark.parametrize("rule", ["majority", "none"])
def test_known_lags_and_marks_are_recovered(spark, rule):
    assert edges(causal.pcmci_plus(frames(spark, series()), 2, 1e-4, rule, block=2).collect()) == TRUE


def test_chunks_gaps_and_panels_do_not_change_the_graph(spark):
    x = series(900)
    both = frames(spark, x).unionByName(frames(spark, series(900, seed=4), 1)).unionByName(frames(spark, x[:3], 2))
    whole = {tuple(r) for r in causal.pcmci_plus(both, 2, 1e-3).collect()}
    parts = {tuple(r) for r in causal.pcmci_plus(both, 2, 1e-3, chunk=100, block=1).collect()}
    assert {r[:5] for r in whole} == {r[:5] for r in parts} and {r[0] for r in whole} == {0, 1}
    shifted = frames(spark, x[:450]).unionByName(frames(spark, x[450:], start=5000))
    assert edges(causal.pcmci_plus(shifted, 2, 1e-3).collect()) == edges(causal.pcmci_plus(frames(spark, x), 2, 1e-3).collect())


def test_a_link_without_collider_stays_open_and_constants_have_none(spark):
    x = np.random.default_rng(0).normal(size=(800, 3))
    x[:, 1] += x[:, 0]
    x[:, 2] = 4.0
    got = {(r["source"], r["lag"], r["target"], r["mark"]) for r in causal.pcmci_plus(frames(spark, x), 1, 1e-4).collect()}
    assert {g for g in got if g[1] == 0} == {(0, 0, 1, "o-o"), (1, 0, 0, "o-o")} and not any(2 in (g[0], g[2]) for g in got)


def test_p_values_are_those_of_students_t():
    # closed forms: 1 degree 1 - 2/pi atan(t), 2 degrees 1 - t / sqrt(2 + t^2), 3 degrees, and the normal limit
    for r in (0.0, 0.05, 0.3, -0.77, 0.99):
        t = abs(r) / math.sqrt(1 - r * r)
        assert pcmci.correlation_p(r, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert pcmci.correlation_p(r, 2) == pytest.approx(1 - abs(r), abs=1e-12)
        assert pcmci.correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * (math.asin(abs(r)) + abs(r) * math.sqrt(1 - r * r)), abs=1e-12)
    assert pcmci.correlation_p(0.02, 1e6) == pytest.approx(math.erfc(0.02 * 1e3 / math.sqrt(2)), rel=1e-2)
    assert pcmci.correlation_p(0.3, 40, 2) == pytest.approx((1 - 0.09) ** 20, rel=1e-12)  # two columns: (1 - r^2)^(freedom / 2)
    assert pcmci.correlation_p(0.3, 2, 40) == pytest.approx(1 - 0.09**20, rel=1e-12)
    assert pcmci.correlation_p(1.0, 5) == 0.0 and pcmci.correlation_p(0.5, 0) == 1.0


def test_partial_correlation_is_that_of_residuals():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 6)) @ r.normal(size=(6, 6))
    test = pcmci.Tests(np.corrcoef(x.T), 400, 6, [[a] for a in range(6)])
    design = np.column_stack([x[:, [2, 4]], np.ones(400)])
    left = x[:, [0, 5]] - design @ np.linalg.lstsq(design, x[:, [0, 5]], rcond=None)[0]
    block = pcmci.Tests(np.corrcoef(x.T), 400, 6, [[0, 1], [2], [4], [5]])
    design_of_two = np.column_stack([x[:, 2], np.ones(400)])
    two = x[:, [0, 1, 5]] - design_of_two @ np.linalg.lstsq(design_of_two, x[:, [0, 1, 5]], rcond=None)[0]
    fit = two[:, :2] @ np.linalg.lstsq(two[:, :2], two[:, 2], rcond=None)[0]
    assert block((0, 0), (3, 0), [(1, 0)])[0] == pytest.approx(np.sqrt((fit**2).sum() / (two[:, 2] ** 2).sum()), abs=1e-9)
    value, p = test((0, 0), (5, 0), [(2, 0), (4, 0)])
    assert value == pytest.approx(np.corrcoef(left.T)[0, 1], abs=1e-12) and p == pcmci.correlation_p(value, 396)


def test_rules_orient_chains_and_cycles():
    def links(now):
        return pcmci.Links({}, {}, {j: dict.fromkeys(now[j], 0.5) for j in now})

    kept = pcmci.Tests(np.eye(8), 1000, 4, [[a] for a in range(4)])
    # 0 - 2 - 1 is a collider; 2 - 3 goes on from it (R1), where 2 is in the separating set of both others and 3
    now = {0: [2], 1: [2], 2: [0, 1, 3], 3: [2]}
    apart = {((0, 0), 1): [], ((0, 0), 3): [2], ((1, 0), 3): [2]}
    mark = pcmci.oriented(kept, links(now), apart, 0.05, "none")
    assert mark[0, 2] == mark[1, 2] == "-->" and mark[2, 3] == "-->" and mark[3, 2] == "<--"
    # two colliders that ask for both directions of 1 - 2
    now = {0: [1], 1: [0, 2], 2: [1, 3], 3: [2]}
    apart = {((0, 0), 2): [], ((1, 0), 3): [], ((0, 0), 3): []}
    assert pcmci.oriented(kept, links(now), apart, 0.05, "none")[1, 2] == "x-x"


def test_context_that_varies_over_panels_is_found_and_its_spurious_link_removed(spark):
    r = np.random.default_rng(8)
    level = r.normal(size=12)
    parts = None
    for m in range(12):
        noise = r.normal(size=(200, 3)) + level[m] * np.array([1, 0, 1])  # one unseen constant of the panel moves 0 and 2
        own = frames(spark, series(contemporaneous=(), lagged_links=((0, 1, 1, 0.4),), noise=noise), m)
        parts = own if parts is None else parts.unionByName(own)
    plain = edges(causal.jpcmci_plus(parts, 1, 0.01, space_dummy=False).collect())
    joint = edges(causal.jpcmci_plus(parts, 1, 0.01).collect())
    assert any({s, j} == {0, 2} for s, _, j, _ in plain)
    assert {(3, 0, 0, "-->"), (3, 0, 2, "-->")} <= joint and not any({s, j} == {0, 2} for s, _, j, _ in joint)
    assert {(0, 1, 1, "-->"), (0, 1, 0, "-->")} <= joint
    # the constant itself, observed, takes the dummy's place
    known = spark.createDataFrame([(m, [float(v)]) for m, v in enumerate(level)], "recording int, c array<double>")
    seen = edges(causal.jpcmci_plus(parts, 1, 0.01, space_context=known, space_dummy=False).collect())
    assert {(3, 0, 0, "-->"), (3, 0, 2, "-->")} <= seen and not any({s, j} == {0, 2} for s, _, j, _ in seen)


def test_context_series_and_time_dummies(spark):
    r = np.random.default_rng(9)
    driver = np.repeat(r.normal(size=10), 30)
    parts, known = None, []
    for m in range(6):
        noise = r.normal(size=(350, 2)) + np.concatenate([np.zeros(50), driver])[:, None]
        own = frames(spark, series(contemporaneous=(), lagged_links=(), noise=noise), m)
        parts = own if parts is None else parts.unionByName(own)
        known += [(m, t, [float(v)]) for t, v in enumerate(driver)]
    context = spark.createDataFrame(known, "recording int, time_index int, c array<double>")
    assert any({s, j} == {0, 1} for s, _, j, _ in edges(causal.jpcmci_plus(parts, 1, 1e-3, space_dummy=False).collect()))
    for more, node in (({"context": context}, 2), ({"time_block": 30}, 2)):
        got = edges(causal.jpcmci_plus(parts, 1, 1e-3, space_dummy=False, **more).collect())
        assert {(node, 0, 0, "-->"), (node, 0, 1, "-->")} <= got and not any({s, j} == {0, 1} for s, _, j, _ in got)
    with pytest.raises(ValueError):
        causal.jpcmci_plus(parts, 1, time_block=1)


def test_one_panel_without_context_is_pcmci_plus(spark):
    x = frames(spark, series(600))
    same = lambda df: {tuple(r[c] for c in ("source", "lag", "target", "mark")) for r in df.collect()}
    assert same(causal.jpcmci_plus(x, 2, 1e-3)) == same(causal.pcmci_plus(x, 2, 1e-3))


def test_products_over_chunks_are_those_of_the_whole(spark):
    x = np.random.default_rng(3).normal(size=(137, 3)) + 5
    df = frames(spark, x[:60]).unionByName(frames(spark, x[60:], start=70))
    got = {(r["lag"], r["source"], r["target"]): (r["product"], r["n"]) for r in lagged.lagged_products(df, [0, 2, 5], chunk=16).collect()}
    for lag in (0, 2, 5):
        want = sum(p[: len(p) - lag].T @ p[lag:] for p in (x[:60], x[60:]))
        assert np.allclose([[got[lag, i, j][0] for j in range(3)] for i in range(3)], want) and got[lag, 0, 0][1] == 137 - 2 * lag


def test_var_and_partial_correlations_equal_the_kernels(spark):
    x = series(300)
    df = frames(spark, x * [1, 1e6, 1e-3, 1])
    b = np.zeros((2, 4, 4))
    for r in lagged.var_coefficients(df, 2, chunk=64).collect():
        b[r["lag"] - 1, r["source"], r["target"]] = r["coefficient"]
    assert np.allclose(b, granger.var_coefficients(x * [1, 1e6, 1e-3, 1], 2), rtol=1e-6)
    rows = granger.stacked_lags(x, 1)
    c = np.linalg.inv(np.corrcoef(rows))
    for r in lagged.partial_correlations(lagged.stacked_correlations(frames(spark, x), 1)).collect():
        i, j = r["row"], r["column"]
        assert r["r"] == pytest.approx(-c[i, j] / math.sqrt(c[i, i] * c[j, j]), abs=1e-9)


def test_cross_correlation_change_is_that_of_matrices(spark):
    x = series(200)
    y = np.cumsum(x, axis=0)
    both = frames(spark, x).withColumn("variant", F.lit("raw")).unionByName(frames(spark, y).withColumn("variant", F.lit("sum")))
    z = lambda v: (v - v.mean(axis=0)) / v.std(axis=0)
    for r in lagged.temporal_dependence_change(both, [1, 4], chunk=50).collect():
        if r["variant"] == "raw":
            assert r["xcf_relative_change"] == 0 and r["acf_change_median"] == 0
        else:
            c = [z(v)[r["lag"] :].T @ z(v)[: -r["lag"]] / (len(v) - r["lag"]) for v in (x, y)]
            assert r["xcf_relative_change"] == pytest.approx(np.linalg.norm(c[1] - c[0]) / np.linalg.norm(c[0]), rel=1e-9)
            assert r["acf_change_median"] == pytest.approx(np.median(np.abs(np.diag(c[1] - c[0]))), rel=1e-9)
