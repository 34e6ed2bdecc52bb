"""Pairwise dependence of lagged series with circular-shift p values, and a least-squares VAR, for one panel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def stacked_lags(x: np.ndarray, depth: int) -> np.ndarray:
    """Rows: the present of all series (of x: time x series), then each earlier step, over the frames that have them all."""
    n = len(x)
    if depth >= n:
        raise ValueError("the series are shorter than the depth")
    return np.concatenate([x[depth - k : n - k].T for k in range(depth + 1)])


def shift_pvalues(a: np.ndarray, b: np.ndarray, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """|correlation| of each row of a with the same row of b, and the share of random circular shifts of a that reach it.

    All shifts' correlations come from one FFT, so draws only pick among them.
    """
    n = a.shape[1]
    z = [(v - v.mean(axis=1, keepdims=True)) / np.where(v.std(axis=1, keepdims=True) > 0, v.std(axis=1, keepdims=True), np.inf) for v in (a, b)]
    every = np.fft.irfft(np.fft.rfft(z[0], axis=1) * np.conj(np.fft.rfft(z[1], axis=1)), n=n, axis=1) / n  # [:, s]: a moved ahead by s
    seen = np.abs(every[:, 0])
    if n <= 2 or draws <= 0:
        return seen, np.ones(len(a))
    shifts = np.random.default_rng(seed).integers(1, n, draws)
    return seen, (np.abs(every[:, shifts]) >= seen[:, None] - 1e-12).mean(axis=1)


def _residuals(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    design = np.column_stack([z.T, np.ones(y.shape[-1])])
    return y - (design @ np.linalg.lstsq(design, y.T, rcond=None)[0]).T


class _Precision:
    """Residuals of pairs of rows given all other rows of a set, from the inverse covariance P of the set and P times the centered rows.

    Given the rest, the residuals of a and b are the inverse of P's 2 x 2 part for (a, b) times their rows of the product. Leaving a row out of the
    set is a downdate of rank one of both. Only the rows of `of` are kept: downdates by one of them need no other.
    """

    def __init__(self, p: np.ndarray, product: np.ndarray, of: np.ndarray):
        self.of, self.p, self.product = of, p, product

    @classmethod
    def over(cls, rows: np.ndarray) -> _Precision | None:
        """None where rows depend on each other, as no inverse exists then."""
        centered = rows - rows.mean(axis=1, keepdims=True)
        size = np.sqrt((centered**2).mean(axis=1))
        if not (size > 0).all():
            return None
        scaled = centered / size[:, None]
        c = scaled @ scaled.T / rows.shape[1]
        values = np.linalg.eigvalsh(c)
        if values[0] <= 1e-9 * values[-1]:
            return None
        p = np.linalg.inv(c)
        return cls(p / np.outer(size, size), (p @ scaled) / size[:, None], np.arange(len(rows)))

    def only(self, of: np.ndarray) -> _Precision:
        return _Precision(self.p[np.ix_(of, of)], self.product[of], of)

    def without(self, row: int) -> _Precision:
        k = int(np.flatnonzero(self.of == row)[0])
        share = self.p[:, k] / self.p[k, k]
        keep = np.arange(len(self.of)) != k
        return _Precision((self.p - np.outer(share, self.p[k]))[np.ix_(keep, keep)], (self.product - np.outer(share, self.product[k]))[keep], self.of[keep])

    def residuals(self, a: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of a and of each of the others, each pair given everything else."""
        i, j = int(np.flatnonzero(self.of == a)[0]), np.searchsorted(self.of, others)
        paa, pab, pbb = self.p[i, i], self.p[i, j], self.p[j, j]
        below = (paa * pbb - pab**2)[:, None]
        ya, yb = self.product[i], self.product[j]
        return (pbb[:, None] * ya - pab[:, None] * yb) / below, (paa * yb - pab[:, None] * ya) / below


def dependence(x: np.ndarray, depth: int, method: str = "cgc", draws: int = 1000, seed: int = 0, exact_alpha: float = 1.0, sources: Sequence[int] | None = None) -> dict[str, np.ndarray]:
    """For every (source, lag, target): corr, corr_p, and the residual correlation inv_corr, inv_p given the conditioning set.

    fcgc conditions on every other row; cgc leaves out later copies of the source. Residuals are only needed where corr_p <= exact_alpha. All come
    from one inverse covariance of the stacked rows; where that doesn't exist, each pair is regressed on its set. sources: all, or those of a task.
    """
    if method not in ("cgc", "fcgc"):
        raise ValueError(f"unknown method {method!r}")
    d, rows = x.shape[1], stacked_lags(x, depth)
    source, lag, target = (v.ravel() for v in np.meshgrid(np.arange(d) if sources is None else np.array(sources, int), np.arange(depth + 1), np.arange(d), indexing="ij"))
    i = lag * d + source
    corr, corr_p = shift_pvalues(rows[i], rows[target], draws, seed)
    inv, inv_p = np.zeros(len(i)), np.ones(len(i))
    same = i == target
    wanted = ~same & (corr_p <= exact_alpha)
    whole = _Precision.over(rows) if wanted.any() else None
    if whole is None:
        for m in np.flatnonzero(wanted):
            drop = {i[m], target[m]} | ({source[m] + k * d for k in range(lag[m])} if method == "cgc" else set())
            r = _residuals(rows[[i[m], target[m]]], np.delete(rows, sorted(drop), axis=0))
            a, p = shift_pvalues(r[:1], r[1:], draws, seed + 1)
            inv[m], inv_p[m] = a[0], p[0]
    else:
        for s in dict.fromkeys(source[wanted].tolist()):
            left = whole.only(np.unique(np.concatenate([np.arange(d), s + d * np.arange(depth + 1)])))
            for k in range(depth + 1):
                if k > 1 and method == "cgc":
                    left = left.without(s + (k - 1) * d)
                for own in (True, False):  # the source's present is left out too, unless it is the target
                    at = np.flatnonzero(wanted & (source == s) & (lag == k) & ((target == s) == own))
                    if len(at):
                        given = left.without(s) if k and not own and method == "cgc" else left
                        inv[at], inv_p[at] = shift_pvalues(*given.residuals(s + k * d, target[at]), draws, seed + 1)
    inv[same], inv_p[same] = corr[same], corr_p[same]
    return {"source": source, "lag": lag, "target": target, "corr": corr, "corr_p": corr_p, "inv_corr": inv, "inv_p": inv_p}


def var_coefficients(x: np.ndarray, depth: int) -> np.ndarray:
    """Least-squares coefficients [lag - 1, source, target] of the present on the last `depth` frames."""
    past = np.column_stack([x[depth - k : len(x) - k] for k in range(1, depth + 1)])
    return np.linalg.lstsq(past, x[depth:], rcond=None)[0].reshape(depth, x.shape[1], x.shape[1])
