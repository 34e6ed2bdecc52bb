import numpy as np
import pytest

from tracewright.kernels import bss, spectral
from tracewright.operators import chunked


def recording(n=700, seed=7):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    s = np.stack([np.sin(t / 4), np.sign(np.sin(t / 7.3)), r.laplace(size=n), r.laplace(size=n)], axis=1)
    return s @ r.normal(size=(4, 6)) + 0.05 * r.normal(size=(n, 6)) + 3


def frames(spark, x, times=None, recording=0, **more):
    rows = [(recording, int(t), [float(v) for v in row], *more.values()) for t, row in zip(range(len(x)) if times is None else times, x, strict=True)]
    return spark.createDataFrame(rows, "recording int, time_index int, x array<double>")


@pytest.mark.parametrize("method", bss.METHODS)
def test_chunks_give_the_rotation_of_the_whole(spark, method):
    x, y = recording(), recording(300, 9)
    both = frames(spark, x).unionByName(frames(spark, y, recording=1)).repartition(3)
    got = chunked.fit_by_chunks(both, method, 4, tol=1e-6, rounds=60, chunk=128).collect()
    for k, own in enumerate((x, y)):
        want = bss.decompose(own, 4, method, 1e-6, 60)
        rows = sorted((r for r in got if r["recording"] == k), key=lambda r: r["component"])
        assert np.allclose([r["mixing"] for r in rows], want.mixing.T, atol=1e-6) and np.allclose([r["unmixing"] for r in rows], want.unmixing, atol=1e-6)
        assert np.allclose(rows[0]["mean"], want.mean) and {r["converged"] for r in rows} == {want.converged} and {r["rounds"] for r in rows} == {want.rounds}
        assert np.allclose([r["energy"] for r in rows], (want.sources**2).mean(axis=0))


@pytest.mark.parametrize("method", ["fastica", "infomax"])
def test_rounds_as_jobs_are_those_in_one_task(spark, method):
    both = frames(spark, recording(300)).unionByName(frames(spark, recording(100, 9), recording=1)).unionByName(frames(spark, recording(1), recording=2))
    model = lambda held: chunked.fit_by_chunks(both, method, 4, tol=1e-3, rounds=8, chunk=64, held=held).orderBy("recording", "component").collect()
    in_task, mixed = model(1 << 20), model(100 * 6 * 8)
    assert [(r["recording"], r["component"], r["rounds"], r["converged"]) for r in in_task] == [(r["recording"], r["component"], r["rounds"], r["converged"]) for r in mixed] and len(mixed) == 8
    assert np.allclose([r["mixing"] for r in in_task], [r["mixing"] for r in mixed], atol=1e-6)


def test_number_of_components_is_checked(spark):
    with pytest.raises(Exception, match="between 1 and 6"):
        chunked.fit_by_chunks(frames(spark, recording(50)), "fastica", 7).collect()
    with pytest.raises(ValueError):
        chunked.fit_by_chunks(frames(spark, recording(50)), "other", 2)


def stepwise(x, cutoff, rate):
    y = x.copy()
    for b0, b1, b2, a1, a2 in spectral.butterworth_sections(cutoff, rate):
        s1 = s2 = np.zeros(x.shape[1])
        for t in range(len(y)):
            v = y[t]
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[t] = out
    return y


@pytest.mark.parametrize("cutoff", [0.02, 0.3, 1.5])
def test_blocks_of_the_filter_are_its_steps(cutoff):
    x = np.random.default_rng(1).normal(size=(301, 3))
    low, want = spectral.Lowpass(cutoff, 4.0), stepwise(x, cutoff, 4.0)
    y, state = low.run(x[:150])
    again, _ = low.run(x[150:], state)
    assert np.allclose(np.concatenate([y, again]), want, atol=1e-12, rtol=0)
    _, rest = low.run(x[150:])
    assert np.allclose(low.power(151) @ state + rest, low.run(x[150:], state)[1], atol=1e-12)


def test_the_scan_is_the_loop(spark):
    x = np.random.default_rng(2).normal(size=(330, 2))
    times = [*range(0, 140), *range(150, 300), *range(310, 350)][:330]
    rows = [(0, 1, t, "train" if 60 <= t < 200 else "test", [float(v) for v in x[i]]) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "recording int, fold int, time_index int, role string, x array<double>").repartition(4)
    got = chunked.lowpass(df, (0.1, 0.5), 4.0, chunk=32).collect()
    assert len(got) == 2 * len(rows)
    edges = [0, *(i for i in range(1, len(times)) if times[i] != times[i - 1] + 1 or (60 <= times[i] < 200) != (60 <= times[i - 1] < 200)), len(times)]
    for cutoff in (0.1, 0.5):
        want = np.concatenate([stepwise(x[a:b], cutoff, 4.0) for a, b in zip(edges, edges[1:], strict=False)])
        own = {r["time_index"]: r["x"] for r in got if r["variant"] == f"causal_lowpass/{cutoff:g}hz"}
        assert np.allclose([own[t] for t in times], want, atol=1e-12, rtol=0)
    assert {r["role"] for r in got} == {"train", "test"}
