"""Ridge, balanced logistic regression, linear latent models and a small network, for one group's matrices."""

from __future__ import annotations

import numpy as np

from .bss import principal_axes


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept that minimise SSE + alpha * |w|^2; the intercept is free."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    c = x - mx
    if x.shape[1] > len(x):
        w = c.T @ np.linalg.solve(c @ c.T + alpha * np.eye(len(x)), y - my)
    else:
        w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - my))
    return w, my - mx @ w


def balanced_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100, tol: float = 1e-8) -> np.ndarray | None:
    """Weights, the last for a column of ones, under an L2 penalty on all of them and class weights n / (2 n_class). None for one class."""
    y = np.asarray(y, float)
    if y.min() == y.max():
        return None
    z = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) * c
    w = np.zeros(z.shape[1])
    loss = lambda v: 0.5 * v @ v + (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v))).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        grad = w + z.T @ (weight * (p - y))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), grad)
        size, now = 1.0, loss(w)
        while size > 1e-10 and loss(w - size * step) > now - 1e-4 * size * (grad @ step):
            size /= 2
        w = w - size * step
        if np.abs(grad).max() < tol:
            break
    return w


def logistic_score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -500, 500)))


def standardizer(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x.std(axis=0)
    return x.mean(axis=0), np.where(s > 0, s, 1.0)


def pca_projection(train: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """x through the k leading axes of the training rows and back."""
    mean, _, axes = principal_axes(train)
    return (x - mean) @ axes[:k].T @ axes[:k] + mean


def random_projection(train: np.ndarray, x: np.ndarray, k: int, seed: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((train.shape[1], k)))
    mean = train.mean(axis=0)
    return (x - mean) @ q @ q.T + mean


def rank_for_energy(train: np.ndarray, share: float) -> int:
    """Fewest leading axes that hold that share of the variance."""
    _, variance, _ = principal_axes(train)
    run = np.cumsum(variance) / variance.sum()
    return int(min(len(variance), np.searchsorted(run, share - 1e-12) + 1))


def factor_projection(train: np.ndarray, x: np.ndarray, k: int, rounds: int = 200, tol: float = 1e-4) -> np.ndarray:
    """Expected data under a factor analysis fitted by EM."""
    mean = train.mean(axis=0)
    c = train - mean
    cov = c.T @ c / len(c)
    _, variance, axes = principal_axes(train)
    load = axes[:k].T * np.sqrt(np.maximum(variance[:k], 1e-9))
    noise = np.maximum(np.diag(cov) - (load**2).sum(axis=1), 1e-6 * np.diag(cov).max() + 1e-12)
    for _ in range(rounds):
        beta = np.linalg.solve(load @ load.T + np.diag(noise), load).T
        moment = np.eye(k) - beta @ load + beta @ cov @ beta.T
        new = cov @ beta.T @ np.linalg.inv(moment)
        moved = np.abs(new - load).max()
        load, noise = new, np.maximum(np.diag(cov - new @ beta @ cov), 1e-9)
        if moved < tol:
            break
    beta = np.linalg.solve(load @ load.T + np.diag(noise), load).T
    return (x - mean) @ beta.T @ load.T + mean


def sparse_projection(train: np.ndarray, x: np.ndarray, k: int, penalty: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Projection on axes with soft-thresholded loadings, alternating loadings and orthonormal scores."""
    mean, _, axes = principal_axes(train)
    c, load = train - mean, axes[:k].T.copy()
    cut = penalty * np.abs(c.T @ c @ load / len(c)).max()
    for _ in range(rounds):
        u, _, v = np.linalg.svd(c.T @ c @ load / len(c), full_matrices=False)
        target = c.T @ c @ (u @ v) / len(c)
        new = np.sign(target) * np.maximum(np.abs(target) - cut, 0)
        norm = np.linalg.norm(new, axis=0)
        new = new / np.where(norm > 0, norm, 1)
        if np.abs(new - load).max() < 1e-6:
            break
        load = new
    return (x - mean) @ np.linalg.pinv(load).T @ load.T + mean


def nonnegative_projection(train: np.ndarray, x: np.ndarray, k: int, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Rank-k non-negative factorization of data shifted by the training minimum and clipped at 0, shifted back."""
    low = train.min(axis=0)
    a, b = np.maximum(train - low, 0), np.maximum(x - low, 0)
    random, eps = np.random.default_rng(seed), 1e-12
    h = random.random((k, a.shape[1])) * np.sqrt(a.mean() / k + eps)
    w = random.random((len(a), k)) * np.sqrt(a.mean() / k + eps)
    for _ in range(rounds):
        h *= (w.T @ a) / (w.T @ w @ h + eps)
        w *= (a @ h.T) / (w @ h @ h.T + eps)
    u = np.full((len(b), k), np.sqrt(b.mean() / k + eps))
    for _ in range(rounds):
        u *= (b @ h.T) / (u @ h @ h.T + eps)
    return u @ h + low


class SmallNetwork:
    """One tanh layer trained by Adam on squared error with early stopping on a tenth of the rows."""

    def __init__(self, hidden: int = 16, seed: int = 0, rounds: int = 500, rate: float = 1e-2, alpha: float = 1e-4, patience: int = 20):
        self.hidden, self.seed, self.rounds, self.rate, self.alpha, self.patience = hidden, seed, rounds, rate, alpha, patience

    def fit(self, x: np.ndarray, y: np.ndarray) -> SmallNetwork:
        random = np.random.default_rng(self.seed)
        order = random.permutation(len(x))
        hold = order[: max(1, len(x) // 10)]
        own = order[len(hold) :] if len(order) > len(hold) else order
        sizes = [(x.shape[1], self.hidden), (self.hidden,), (self.hidden, y.shape[1]), (y.shape[1],)]
        p = [random.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
        m, v = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
        best, self.p, bad, self.converged = np.inf, [a.copy() for a in p], 0, False
        for t in range(1, self.rounds + 1):
            h = np.tanh(x[own] @ p[0] + p[1])
            d = (h @ p[2] + p[3] - y[own]) / len(own)
            back = d @ p[2].T * (1 - h**2)
            grads = [x[own].T @ back + self.alpha * p[0], back.sum(axis=0), h.T @ d + self.alpha * p[2], d.sum(axis=0)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            loss = float(((np.tanh(x[hold] @ p[0] + p[1]) @ p[2] + p[3] - y[hold]) ** 2).mean())
            if loss < best - 1e-6:
                best, self.p, bad = loss, [a.copy() for a in p], 0
            else:
                bad += 1
                if bad >= self.patience:
                    self.converged = True
                    break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]
