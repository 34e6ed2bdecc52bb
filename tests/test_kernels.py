import numpy as np
import pytest

from tracewright.kernels import bss, granger, models, spectral


def mixed(seed=7, n=400):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    s = np.stack([np.sin(t / 4), np.sign(np.sin(t / 7.3)), r.laplace(size=n)], axis=1)
    return s, s @ r.normal(size=(3, 5)) + r.normal(size=5)


@pytest.mark.parametrize("method", bss.METHODS)
def test_full_rank_round_trip_and_inverse(method):
    _, x = mixed()
    x = x + np.random.default_rng(1).normal(0, 0.05, x.shape)
    d = bss.decompose(x, 5, method, rounds=200)
    assert np.allclose(bss.reconstruct(d), x, atol=1e-9)
    assert np.allclose(d.unmixing @ d.mixing, np.eye(5), atol=1e-9)


@pytest.mark.parametrize("method", ["fastica", "sobi", "jade"])
def test_sources_are_found_up_to_order_and_sign(method):
    s, x = mixed()
    d = bss.decompose(x, 3, method)
    c = np.abs(np.corrcoef(s.T, d.sources.T)[:3, 3:])
    assert (c.max(axis=1) > 0.9).all()


def test_keep_and_reject_are_complements():
    _, x = mixed()
    d = bss.decompose(x, 3, "sobi")
    assert np.allclose(bss.reconstruct(d, keep=[0, 2]), bss.reconstruct(d, reject=[1]))
    with pytest.raises(ValueError):
        bss.reconstruct(d, keep=[0], reject=[1])


def test_segments_count_pairs_inside_only():
    z = np.arange(12.0).reshape(6, 2)
    c = bss.lagged_covariances(z, [1], [3, 3])[0]
    pairs = [(0, 1), (1, 2), (3, 4), (4, 5)]
    m = sum(np.outer(z[b], z[a]) for a, b in pairs) / 4
    assert np.allclose(c, (m + m.T) / 2)


def test_welch_keeps_variance_and_finds_the_tone():
    t = np.arange(2048)
    x = np.sin(2 * np.pi * 0.125 * t)
    f, p = spectral.welch(x, 1.0, 256)
    assert f[p.argmax()] == pytest.approx(0.125)
    assert (p * (f[1] - f[0])).sum() == pytest.approx(x.var(), rel=0.02)


def test_segmented_welch_of_one_segment_is_welch():
    x = np.random.default_rng(0).normal(size=(300, 2))
    assert np.allclose(spectral.segmented_welch(x, [300], 4.0, 64)[1], spectral.welch(x, 4.0, 64)[1])


def test_butterworth_gain():
    s = spectral.butterworth_sections(0.2, 2.0)
    gain = lambda w: abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in s for z in [np.exp(-1j * w)]]))
    assert gain(0) == pytest.approx(1)
    assert gain(2 * np.pi * 0.2 / 2.0) == pytest.approx(2**-0.5)
    assert gain(np.pi * 0.9) < 1e-4


def test_lowpass_is_causal_and_starts_anew():
    x = np.random.default_rng(0).normal(size=(60, 2))
    y = spectral.causal_lowpass(x, 0.3, 2.0, [30, 30])
    changed = x.copy()
    changed[45:] += 5
    assert np.allclose(spectral.causal_lowpass(changed, 0.3, 2.0, [30, 30])[:45], y[:45])
    assert np.allclose(spectral.causal_lowpass(x[30:], 0.3, 2.0), y[30:])


def test_kmeans_finds_separate_groups():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(m, 0.1, (20, 2)) for m in (0, 5, 10)])
    assert spectral.kmeans(x, 3, 0).tolist() == [0] * 20 + [1] * 20 + [2] * 20


def test_ridge_solves_its_equations_either_way():
    r = np.random.default_rng(0)
    for n, d in ((50, 4), (10, 30)):
        x, y = r.normal(size=(n, d)), r.normal(size=n)
        w, b = models.ridge(x, y, 3.0)
        grad = x.T @ (x @ w + b - y) + 3.0 * w
        assert np.allclose(grad, 0, atol=1e-8) and (x @ w + b - y).sum() == pytest.approx(0, abs=1e-8)


def test_logistic_gradient_vanishes_and_one_class_is_refused():
    r = np.random.default_rng(0)
    x = r.normal(size=(80, 3))
    y = (x[:, 0] + 0.5 * r.normal(size=80) > 0.7).astype(float)
    w = models.balanced_logistic(x, y)
    z = np.column_stack([x, np.ones(80)])
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    assert np.allclose(w + z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)), 0, atol=1e-5)
    assert models.balanced_logistic(x, np.ones(80)) is None


def test_projections_at_full_rank_give_data_back():
    x = np.random.default_rng(0).normal(size=(40, 4))
    assert np.allclose(models.pca_projection(x, x, 4), x)
    assert np.allclose(models.random_projection(x, x, 4, 0), x)
    assert np.abs(models.nonnegative_projection(x, x, 4, rounds=4000) - x).mean() < 0.2


def test_granger_finds_the_edge():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    for t in range(1, 400):
        x[t, 1] += 0.8 * x[t - 1, 0]
    for method in ("cgc", "fcgc"):
        d = granger.dependence(x, 1, method, 300, 1)
        hit = (d["source"] == 0) & (d["lag"] == 1) & (d["target"] == 1)
        back = (d["source"] == 1) & (d["lag"] == 1) & (d["target"] == 0)
        assert d["inv_p"][hit][0] < 0.01 < d["inv_p"][back][0] + 0.02
    b = np.abs(granger.var_coefficients(x, 1)[0])
    assert b[0, 1] > 0.6 and b[1, 0] < 0.2


def test_shift_correlation_is_plain_correlation():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 50)), r.normal(size=(2, 50))
    seen, _ = granger.shift_pvalues(a, b, 10, 0)
    assert np.allclose(seen, [abs(np.corrcoef(a[i], b[i])[0, 1]) for i in range(2)])


def test_null_orders_keep_blocks_and_shifts():
    from tracewright.kernels.draws import hashed, null_order

    time = np.concatenate([np.arange(25), np.arange(40, 57)])
    order = null_order(time, "block_shuffle", 3, 10, 1)
    assert sorted(order) == list(range(42)) and (order != np.arange(42)).any()
    inside = np.diff(order) == 1
    assert inside.sum() >= 42 - 5  # five blocks: 10, 10, 5 and 10, 7
    shift = null_order(time, "circular_shift", 3, 10, 15)
    by = (np.arange(42) - shift) % 42
    assert len(set(by)) == 1 and 15 <= by[0] <= 27
    assert null_order(time[:1], "circular_shift", 3, 10, 15).tolist() == [0]
    draws = hashed(400, 50, 7)
    assert abs((draws & np.uint64(1)).mean() - 0.5) < 0.02 and abs((draws % np.uint64(50)).mean() - 24.5) < 0.5
    assert len(np.unique(draws)) > 19_990


@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_every_pair_meets_once_and_rounds_are_disjoint(k):
    met = [tuple(pair) for p, q in bss.pairings(k) for pair in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(met) == [(a, b) for a in range(k) for b in range(a + 1, k)]
    assert all(len(set(p) | set(q)) == 2 * len(p) for p, q in bss.pairings(k))


def test_matrices_of_one_basis_become_diagonal():
    r = np.random.default_rng(3)
    basis = np.linalg.qr(r.normal(size=(7, 7)))[0]
    matrices = np.stack([basis @ np.diag(r.normal(size=7)) @ basis.T for _ in range(5)])
    turn, _, ok = bss.joint_rotation(matrices, 1e-10, 100)
    assert ok and np.allclose(turn.T @ turn, np.eye(7))
    left = turn.T @ matrices @ turn
    assert np.abs(left - np.stack([np.diag(np.diag(m)) for m in left])).max() < 1e-8


@pytest.mark.parametrize(("method", "seed", "rounds"), [("infomax", 959, 500), ("infomax", 670, 500), ("sobi", 1018, 200), ("jade", 392, 150)])
def test_fits_of_nearly_normal_data_end(method, seed, rounds):
    x = np.random.default_rng(seed).normal(size=(250, 16))
    d = bss.decompose(x, 8, method, rounds=rounds)
    assert d.converged and d.rounds < rounds
    assert np.allclose(np.cov(d.sources.T), np.eye(8), atol=1e-9)
    if method == "infomax":
        moment = np.tanh(d.sources / 2).T @ d.sources / len(x)
        assert np.abs(moment - moment.T).max() < 1.01e-4
    elif method == "sobi":
        m = bss.lagged_covariances(d.sources, (1, 2, 3, 5))
        p, q = np.triu_indices(8, 1)
        off = m[:, p, q] + m[:, q, p]
        own = m[:, p, p] - m[:, q, q]
        a, b = (own**2 - off**2).sum(axis=0), (2 * own * off).sum(axis=0)
        assert np.abs(np.arctan2(b, a + np.hypot(a, b))).max() / 2 < 1.01e-4


def test_all_pairs_turned_at_once_reach_the_diagonal():
    r = np.random.default_rng(4)
    turn = np.linalg.qr(r.normal(size=(6, 6)))[0]
    near = np.linalg.qr(np.eye(6) + 0.05 * r.normal(size=(6, 6)))[0]
    m = np.stack([near.T @ np.diag(r.normal(size=6)) @ near for _ in range(5)], axis=2)
    found, n = bss._turned_at_once(m, 1e-9, 100)
    assert n < 100 and np.allclose(found.T @ found, np.eye(6))
    seen = bss._seen(m, found)
    assert np.abs(seen - np.einsum("iim,ij->ijm", seen, np.eye(6))).max() < 1e-8
    assert np.allclose(bss._seen(m, turn)[:, :, 2], turn.T @ m[:, :, 2] @ turn)
