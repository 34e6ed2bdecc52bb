import numpy as np
import pytest

from tracewright.operators import decoding, folds, ridge


@pytest.mark.parametrize("chunk", [17, 4096])
def test_predictions_are_those_of_whole_matrices(spark, chunk):
    r = np.random.default_rng(5)
    n = 150
    x = {"raw": np.cumsum(r.normal(size=(n, 3)), axis=0) + 40}
    x["clean"] = x["raw"] @ r.normal(size=(3, 3)) * 0.3
    x["constant"] = np.column_stack([x["raw"][:, :2], np.full(n, 2.0)])
    rows = [(k, name, t, [float(v) for v in own[t]]) for k in (0, 1) for name, own in x.items() for t in range(n)]
    variants = spark.createDataFrame(rows, "recording int, variant string, time_index int, x array<double>").repartition(3)
    targets = spark.createDataFrame([(k, t, float(x["raw"][t, 0] ** 2 + k), float(np.sin(t / 9))) for k in (0, 1) for t in range(n)], "recording int, time_index int, a double, b double")
    edges = folds.fold_edges(variants.filter("variant = 'raw'"), 3, 5)
    wanted = [decoding.Target("a", "a"), decoding.Target("b", "b")]
    keys = ["recording", "target", "comparison", "train_version", "test_version", "fold", "time_index"]
    want = {tuple(r[k] for k in keys): (r["n_train"], r["y_true"], r["y_pred"]) for r in decoding.decode(variants, targets, edges, wanted, (0, 2), 1, 10.0).collect()}
    got = {tuple(r[k] for k in keys): (r["n_train"], r["y_true"], r["y_pred"]) for r in ridge.ridge_by_folds(variants, targets, edges, ["a", "b"], (0, 2), 1, 10.0, chunk=chunk).collect()}
    assert set(got) == set(want) and len(got) > 1000
    for k, (m, y, f) in want.items():
        assert got[k][0] == m and got[k][1] == y and got[k][2] == pytest.approx(f, rel=1e-9, abs=1e-9)


def test_frames_without_a_target_take_no_part(spark):
    rows = [(0, "raw", t, [float(t % 7), float(t % 5)]) for t in range(80)]
    variants = spark.createDataFrame(rows, "recording int, variant string, time_index int, x array<double>")
    targets = spark.createDataFrame([(0, t, float(t % 3)) for t in range(80) if t % 10], "recording int, time_index int, y double")
    edges = folds.fold_edges(variants, 2, 3)
    got = ridge.ridge_by_folds(variants, targets, edges, ["y"], (0, 1), chunk=16).collect()
    assert got and all(r["time_index"] % 10 for r in got) and {r["comparison"] for r in got} == {"within"}
