"""Welch power spectra per segment, a causal Butterworth low-pass, and k-means, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def welch(x: np.ndarray, rate: float, nperseg: int = 256, noverlap: int | None = None, nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density along the first axis: Hann windows, constant detrending, half overlap by default."""
    x = np.asarray(x, float)
    nperseg = min(nperseg, len(x))
    noverlap = nperseg // 2 if noverlap is None else min(noverlap, nperseg - 1)
    nfft = nfft or nperseg
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    starts = range(0, len(x) - nperseg + 1, nperseg - noverlap)
    shape = (-1,) + (1,) * (x.ndim - 1)
    total = 0.0
    for s in starts:
        part = x[s : s + nperseg]
        total = total + np.abs(np.fft.rfft((part - part.mean(axis=0)) * window.reshape(shape), n=nfft, axis=0)) ** 2
    power = total / len(starts) / (rate * (window**2).sum())
    power[1 : -1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, 1 / rate), power


def segmented_welch(x: np.ndarray, segments: Sequence[int], rate: float, nperseg: int = 256, noverlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean of each segment's spectrum on a common frequency grid; segments under two samples are skipped."""
    edges = np.concatenate([[0], np.cumsum(segments)]).astype(int)
    spans = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a >= 2]
    if not spans:
        raise ValueError("no segment has two samples")
    nfft = min(nperseg, max(b - a for a, b in spans))
    spectra = [welch(x[a:b], rate, min(nperseg, b - a), None if noverlap is None else min(noverlap, min(nperseg, b - a) - 1), nfft) for a, b in spans]
    weights = np.array([b - a for a, b in spans], float)
    return spectra[0][0], np.tensordot(weights / weights.sum(), np.stack([p for _, p in spectra]), axes=1)


def butterworth_sections(cutoff: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital low-pass of even order by the bilinear transform."""
    if not 0 < cutoff < rate / 2 or order % 2:
        raise ValueError("the cutoff must lie under half the rate and the order be even")
    w = 2 * rate * np.tan(np.pi * cutoff / rate)
    out = []
    for i in range(order // 2):
        damping = -2 * np.cos(np.pi * (2 * i + order + 1) / (2 * order))
        k = 2 * rate
        a = np.array([k * k + damping * w * k + w * w, 2 * w * w - 2 * k * k, k * k - damping * w * k + w * w])
        b = np.array([1.0, 2.0, 1.0]) * w * w
        out.append([*(b / a[0]), a[1] / a[0], a[2] / a[0]])
    return np.array(out)


class Lowpass:
    """The low-pass as a linear system: state' = a state + b v, y = c state + d v, for all channels alike; blocks of frames are products of matrices."""

    def __init__(self, cutoff: float, rate: float, order: int = 4, block: int = 64):
        sections = butterworth_sections(cutoff, rate, order)
        self.order, self.block = order, block

        def moved(state: np.ndarray, v: float) -> np.ndarray:
            after = np.empty(order)
            for i, (b0, b1, b2, a1, a2) in enumerate(sections):
                out = b0 * v + state[2 * i]
                after[2 * i], after[2 * i + 1] = b1 * v - a1 * out + state[2 * i + 1], b2 * v - a2 * out
                v = out
            return np.append(after, v)

        steps = np.stack([moved(e, 0.0) for e in np.eye(order)] + [moved(np.zeros(order), 1.0)], axis=1)
        self.a, self.b, self.c, self.d = steps[:-1, :-1], steps[:-1, -1], steps[-1, :-1], steps[-1, -1]
        powers = [np.eye(order)]
        for _ in range(block):
            powers.append(self.a @ powers[-1])
        response = np.array([self.d, *(self.c @ p @ self.b for p in powers[:-1])])
        back = np.arange(block)[:, None] - np.arange(block)[None, :]
        self.of_input = np.where(back >= 0, response[np.maximum(back, 0)], 0.0)
        self.of_state = np.stack([self.c @ p for p in powers[:-1]])
        self.into_state = np.stack([p @ self.b for p in powers[:-1]], axis=1)  # of an input so many frames before the last
        self.powers = powers

    def power(self, n: int) -> np.ndarray:
        """What n frames make of a state."""
        return np.linalg.matrix_power(self.a, int(n))

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The filtered frames (time x channels) and the state after them."""
        y, s = np.empty(x.shape), np.zeros((self.order, x.shape[1])) if state is None else state
        for at in range(0, len(x), self.block):
            v = x[at : at + self.block]
            n = len(v)
            y[at : at + n] = self.of_state[:n] @ s + self.of_input[:n, :n] @ v
            s = self.powers[n] @ s + self.into_state[:, n - 1 :: -1][:, :n] @ v if n else s
        return y, s


def causal_lowpass(x: np.ndarray, cutoff: float, rate: float, segments: Sequence[int] | None = None, order: int = 4) -> np.ndarray:
    """Forward filtering that starts from rest in every segment, along the first axis."""
    x = np.asarray(x, float)
    flat, low = x.reshape(len(x), -1), Lowpass(cutoff, rate, order)
    edges = np.concatenate([[0], np.cumsum(segments if segments is not None else [len(x)])]).astype(int)
    return np.concatenate([flat[:0], *(low.run(flat[a:b])[0] for a, b in zip(edges[:-1], edges[1:], strict=True))]).reshape(x.shape)


def kmeans(x: np.ndarray, k: int, seed: int, tries: int = 10, rounds: int = 300) -> np.ndarray:
    """Labels of the best of several seeded k-means++ runs, numbered by first appearance."""
    random, best = np.random.default_rng(seed), None
    k = min(k, len(np.unique(x, axis=0)))
    for _ in range(tries):
        centers = x[[random.integers(len(x))]]
        while len(centers) < k:
            d = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
            centers = np.concatenate([centers, x[[random.choice(len(x), p=d / d.sum())]]])
        labels = None
        for _ in range(rounds):
            d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centers = np.stack([x[labels == i].mean(axis=0) if (labels == i).any() else x[d.min(axis=1).argmax()] for i in range(k)])
        inertia = ((x - centers[labels]) ** 2).sum()
        if best is None or inertia < best[0] - 1e-12:
            best = inertia, labels
    _, first = np.unique(best[1], return_index=True)
    rename = np.argsort(np.argsort(first))
    return rename[np.searchsorted(np.unique(best[1]), best[1])]
