"""Blind source separation of one time-by-neuron matrix in numpy: whitening, FastICA, Infomax, SOBI and JADE."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np

METHODS = ("fastica", "infomax", "sobi", "jade")


@dataclass
class Decomposition:
    """sources (time x k), mixing (neurons x k), mean (neurons), unmixing (k x neurons): x = sources @ mixing.T + mean."""

    sources: np.ndarray
    mixing: np.ndarray
    mean: np.ndarray
    unmixing: np.ndarray
    rounds: int
    converged: bool


def principal_axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances (n - 1) in falling order and axes as rows; each axis's largest loading is positive."""
    mean = x.mean(axis=0)
    _, s, axes = np.linalg.svd(x - mean, full_matrices=False)
    lead = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    return mean, s**2 / max(1, len(x) - 1), axes * np.where(lead < 0, -1.0, 1.0)[:, None]


def whitened(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k decorrelated coordinates of unit variance, the mean, and the map from centered data."""
    if not 1 <= k <= min(x.shape):
        raise ValueError(f"the number of components must be between 1 and {min(x.shape)}, got {k}")
    mean, variance, axes = principal_axes(x)
    to_white = axes[:k] / np.sqrt(np.maximum(variance[:k], np.finfo(float).eps))[:, None]
    return (x - mean) @ to_white.T, mean, to_white


def decorrelated(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w, full_matrices=False)
    return u @ v


def lagged_covariances(z: np.ndarray, lags: Sequence[int], segments: Sequence[int] | None = None) -> np.ndarray:
    """Symmetrized covariances at each lag, over pairs that lie in one segment."""
    edges = np.concatenate([[0], np.cumsum(segments if segments is not None else [len(z)])]).astype(int)
    if edges[-1] != len(z):
        raise ValueError("segments must cover all samples")
    out = []
    for lag in lags:
        parts = [z[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > lag > 0]
        if parts:
            c = sum(p[lag:].T @ p[:-lag] for p in parts) / sum(len(p) - lag for p in parts)
            out.append((c + c.T) / 2)
    if not out:
        raise ValueError("no lag fits into a segment")
    return np.stack(out)


def fourth_cumulants(z: np.ndarray, most: int = 200) -> np.ndarray:
    """Cumulant matrices cum(z_a, z_b, z_c, z_d) over (c, d) of white data, one for each pair a <= b of coordinates, `most` at most."""
    pairs = np.stack(np.triu_indices(z.shape[1]), axis=1)[:most]
    return cumulants_of(np.stack([(z * (z[:, a] * z[:, b])[:, None]).T @ z for a, b in pairs]) / len(z))


def cumulants_of(moments: np.ndarray) -> np.ndarray:
    """The same from the fourth moments E[z_a z_b z_c z_d] of the first pairs a <= b."""
    k = moments.shape[1]
    pairs = np.stack(np.triu_indices(k), axis=1)[: len(moments)]
    unit = np.eye(k)
    of_a, of_b = unit[pairs[:, 0]], unit[pairs[:, 1]]
    gaussian = (of_a * of_b).sum(axis=1)[:, None, None] * unit + of_a[:, :, None] * of_b[:, None, :] + of_b[:, :, None] * of_a[:, None, :]
    return moments - gaussian


def pairings(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs p < q of 0 .. k - 1 in rounds of disjoint pairs, as a round-robin tournament meets: one stays, the others move on by a place."""
    places = list(range(k + k % 2))  # of an odd number one rests, against the place that isn't there
    out = []
    for _ in range(len(places) - 1):
        met = sorted(tuple(sorted(pair)) for pair in zip(places[: len(places) // 2], places[::-1], strict=False))
        met = [pair for pair in met if pair[1] < k]
        out.append((np.array([p for p, _ in met], int), np.array([q for _, q in met], int)))
        places = [places[0], places[-1], *places[1:-1]]
    return out


@dataclass(frozen=True)
class Search:
    """L-BFGS over rotations: the last accepted one with its slope and cost, the step along the next direction, whether that is the first of its
    search, the accepted rounds, for the last of these how far each turned and how far the slope fell by it, oldest first, and the curvature of each
    pair of sources by itself where that is known.
    """

    turn: np.ndarray
    slope: np.ndarray | None = None
    cost: float = 0.0
    step: float = 1.0
    first: bool = True
    rounds: int = 0
    pairs: tuple[tuple[np.ndarray, np.ndarray], ...] = ()
    curvature: np.ndarray | None = None

    def direction(self) -> np.ndarray:
        """The slope times the inverse curvature that is known or that the pairs tell of; the slope itself without any."""
        out, parts = self.slope, []
        for turned, fall in reversed(self.pairs):
            parts.append((turned * out).sum() / (turned * fall).sum())
            out = out - parts[-1] * fall
        if self.curvature is not None:
            out = out / self.curvature
        elif self.pairs:
            turned, fall = self.pairs[-1]
            out = out * ((turned * fall).sum() / (fall * fall).sum())
        for (turned, fall), part in zip(self.pairs, reversed(parts), strict=True):
            out = out + (part - (fall * out).sum() / (turned * fall).sum()) * turned
        return out

    def trial(self) -> np.ndarray:
        """The next rotation to measure, by a Cayley transform, so it stays one."""
        if self.slope is None:
            return self.turn
        half, one = self.step / 2 * self.direction(), np.eye(len(self.turn))
        return self.turn @ np.linalg.solve(one - half, one + half)

    def told(self, trial: np.ndarray, moment: np.ndarray, cost: float, sufficient: float = 1e-4, widest_step: float = 8.0, kept: int = 10) -> Search:
        """After the trial's moment and cost: the step halved until the cost falls enough (Armijo). Where the slope fell along the step, the pair joins
        the last `kept` and the next step is whole; else they are dropped and the step is doubled if it did at once.
        """
        slope, pairs, step = moment - moment.T, self.pairs, self.step
        if self.slope is None:
            return replace(self, slope=slope, cost=cost)
        direction = self.direction()
        if cost > self.cost - sufficient * step * (self.slope * direction).sum() / 2 and step >= 1e-12:
            return replace(self, step=step / 2, first=False)
        turned, fall = step * direction, self.slope - slope
        if (turned * fall).sum() > 1e-8 * np.sqrt((turned**2).sum() * (fall**2).sum()):
            pairs, step = (*pairs, (turned, fall))[-kept:], 1.0
        else:
            pairs, step = (), min(widest_step, 2 * step) if self.first else step
        return Search(trial, slope, cost, step, True, self.rounds + 1, pairs, self.curvature)

    def stationary(self, tol: float) -> bool:
        return bool(np.abs(self.slope).max(initial=0) < tol)


#: Sweeps before a joint diagonalization also turns all pairs at once.
PATIENT = 50


def _seen(m: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Matrices of (row, column, matrix) after a rotation."""
    return np.ascontiguousarray(np.tensordot(turn, np.tensordot(m, turn, (1, 0)), (0, 0)).transpose(0, 2, 1))


def _pair_sums(own: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b of the angle of pairs whose diagonal entries differ by own and whose two others sum to off, over all matrices (the last axis)."""
    return (own * own).sum(axis=-1) - (off * off).sum(axis=-1), 2 * (own * off).sum(axis=-1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 0.5 * np.arctan2(b, a + np.hypot(a, b))


def _turned_at_once(m: np.ndarray, tol: float, rounds: int) -> tuple[np.ndarray, int]:
    """A rotation that raises the squared diagonals of all matrices (row, column, matrix) by `rounds` of Search at most, fewer where no pair is left to turn
    by more than tol; and how many these were.
    """
    m = m / (np.sqrt((m**2).sum()) or 1.0)
    search = Search(np.eye(len(m)))
    for n in range(rounds):
        trial = search.trial()
        now = _seen(m, trial)
        own = np.einsum("iim->im", now)
        a, b = _pair_sums(own[:, None] - own, now + now.transpose(1, 0, 2))
        np.fill_diagonal(b, 0.0)
        left = np.abs(np.sin(_angles(np.where(np.eye(len(m)), 1.0, a), b))).max(initial=0.0)
        if search.slope is None:
            search = replace(search, curvature=2 * np.maximum(a, 1e-3 * np.abs(a).mean()))
        search = search.told(trial, -2 * np.einsum("im,ijm->ij", own, now), -(own**2).sum() / 2)
        if left <= tol and search.turn is trial:
            return trial, n + 1
    return search.turn, rounds


def joint_rotation(matrices: np.ndarray, tol: float, rounds: int) -> tuple[np.ndarray, int, bool]:
    """The rotation that makes symmetric matrices as diagonal as possible together: Jacobi sweeps with the closed-form angle
    theta = atan2(b, a + hypot(a, b)) / 2 of Cardoso and Souloumiac (1996). Disjoint pairs don't change each other's angle and turn together.

    Sweeps creep where many pairs have to turn a little at once; fits that PATIENT sweeps don't end have rounds of Search for the same sums between
    further sweeps. A sweep that has nothing to turn ends every fit.
    """
    m, k = np.ascontiguousarray(matrices.transpose(1, 2, 0)), matrices.shape[1]  # an entry of all matrices lies together
    turn, order = np.eye(k), pairings(k)
    few = max(1, 2**18 // max(1, m[0].nbytes))  # rows at a time that stay in the cache
    used = 0
    while used < rounds:
        largest = 0.0
        for p, q in order:
            d, o = m[p, p] - m[q, q], m[p, q] + m[q, p]
            theta = _angles(*_pair_sums(d, o))
            sine = np.abs(np.sin(theta))
            largest = max(largest, sine.max(initial=0.0))
            theta = np.where(sine <= tol, 0.0, theta)
            c, s = np.cos(theta), np.sin(theta)
            for at in range(0, k, few):
                rows, of_p, of_q = m[at : at + few], c[:, None], s[:, None]
                left, right = rows[:, p], rows[:, q]
                rows[:, p], rows[:, q] = left * of_p + right * of_q, right * of_p - left * of_q
            for at in range(0, len(p), few):
                i, j, of_p, of_q = p[at : at + few], q[at : at + few], c[at : at + few, None, None], s[at : at + few, None, None]
                left, right = m[i], m[j]
                m[i], m[j] = left * of_p + right * of_q, right * of_p - left * of_q
            left, right = turn[:, p], turn[:, q]
            turn[:, p], turn[:, q] = left * c + right * s, right * c - left * s
        used += 1
        if largest <= tol:
            return turn, used, True
        if used >= PATIENT:
            more, n = _turned_at_once(m, tol / 2, min(2 * PATIENT, rounds - used))
            m, turn, used = _seen(m, more), turn @ more, used + n
    return turn, rounds, False


def fastica_rotation(z: np.ndarray, tol: float, rounds: int, seed: int) -> tuple[np.ndarray, int, bool]:
    """Symmetric FastICA with the log cosh contrast."""
    k = z.shape[1]
    w = decorrelated(np.random.default_rng(seed).standard_normal((k, k)))
    for i in range(rounds):
        g = np.tanh(z @ w.T)
        new = decorrelated(g.T @ z / len(z) - (1 - g**2).mean(axis=0)[:, None] * w)
        change = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if change < tol:
            return w.T, i + 1, True
    return w.T, rounds, False


def infomax_start(k: int, seed: int) -> Search:
    return Search(np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((k, k)))[0])


def infomax_moments(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over samples of tanh(y / 2) y' and of minus the log-likelihood."""
    return np.tanh(y / 2).T @ y, 2 * np.logaddexp(y / 2, -y / 2).sum()


def infomax_rotation(z: np.ndarray, tol: float, rounds: int, seed: int) -> tuple[np.ndarray, int, bool]:
    """Infomax as maximum likelihood of logistic sources (Amari, Cichocki and Yang 1996; Cardoso 1997) over the rotations of white data.

    The natural gradient of a rotation is the skew part of E[tanh(y / 2) y']; Search follows it with the curvature of its last rounds, as steps along
    the gradient alone need hundreds of rounds where sources are close to normal (Ablin, Cardoso and Gramfort 2018). Stationary below tol.
    """
    search = infomax_start(z.shape[1], seed)
    while search.rounds < rounds:
        trial = search.trial()
        moment, cost = infomax_moments(z @ trial)
        search = search.told(trial, moment / len(z), cost / len(z))
        if search.rounds < rounds and search.stationary(tol):
            return search.turn, search.rounds, True
    return search.turn, rounds, False


def decompose(x: np.ndarray, k: int, method: str = "fastica", tol: float = 1e-4, rounds: int = 500, seed: int = 0, lags: Sequence[int] = (1, 2, 3, 5), segments: Sequence[int] | None = None, cumulants: int = 200) -> Decomposition:
    """Sources in falling order of the energy that they mix into the data; each column of the mixing has a positive largest loading."""
    z, mean, to_white = whitened(np.asarray(x, float), k)
    if method in ("fastica", "ica"):
        turn, n, ok = fastica_rotation(z, tol, rounds, seed)
    elif method == "infomax":
        turn, n, ok = infomax_rotation(z, tol, rounds, seed)
    elif method == "sobi":
        turn, n, ok = joint_rotation(lagged_covariances(z, lags, segments), tol, rounds)
    elif method == "jade":
        turn, n, ok = joint_rotation(fourth_cumulants(z, cumulants), tol, rounds)
    else:
        raise ValueError(f"unknown method {method!r}")
    unmixing = turn.T @ to_white
    mixing = np.linalg.pinv(unmixing)
    order = np.argsort(-(mixing**2).sum(axis=0), kind="stable")
    lead = mixing[np.abs(mixing).argmax(axis=0), np.arange(k)]
    sign = np.where(lead < 0, -1.0, 1.0)
    unmixing, mixing = (unmixing * sign[:, None])[order], (mixing * sign)[:, order]
    return Decomposition((x - mean) @ unmixing.T, mixing, mean, unmixing, n, ok)


def reconstruct(d: Decomposition, keep: Sequence[int] | None = None, reject: Sequence[int] | None = None) -> np.ndarray:
    k = d.mixing.shape[1]
    if keep is not None and reject is not None:
        raise ValueError("give keep or reject, not both")
    kept = np.arange(k) if keep is None and reject is None else np.array(sorted(keep), int) if keep is not None else np.setdiff1d(np.arange(k), reject)
    if len(kept) and (kept.min() < 0 or kept.max() >= k):
        raise ValueError("component out of range")
    return d.sources[:, kept] @ d.mixing[:, kept].T + d.mean
