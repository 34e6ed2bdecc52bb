"""Draws from hashes that SQL can repeat: no state, so a draw depends on its seed and its numbers alone."""

from __future__ import annotations

import hashlib

import numpy as np

NULL_STRATEGIES = ("block_shuffle", "circular_shift")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The 32-bit finalizer of MurmurHash3, on unsigned 64-bit integers below 2**32."""
    low = np.uint64(0xFFFFFFFF)
    h = h ^ (h >> np.uint64(16))
    h = (h * np.uint64(0x85EBCA6B)) & low
    h = h ^ (h >> np.uint64(13))
    h = (h * np.uint64(0xC2B2AE35)) & low
    return h ^ (h >> np.uint64(16))


def hashed(rows: int, columns: int, seed: int) -> np.ndarray:
    """rows x columns unsigned 32-bit values: mixed(mixed(row + 2654435769 * (seed + 1)) + 2654435769 * (column + 1)), sums modulo 2**32."""
    step, low = np.uint64(2654435769), np.uint64(0xFFFFFFFF)
    r = _mixed((np.arange(rows, dtype=np.uint64) + step * np.uint64(seed + 1)) & low)
    return _mixed((r[:, None] + (step * (np.arange(columns, dtype=np.uint64) + np.uint64(1)) & low)[None, :]) & low)


def null_order(time: np.ndarray, strategy: str, seed: int, block_size: int, min_shift: int) -> np.ndarray:
    """Which row's value each row of a series gets: blocks that never span a gap of time in the order of md5(seed:block), or a circular shift
    by at least min_shift rows (half of the series at most) either way.
    """
    n = len(time)
    if strategy not in NULL_STRATEGIES:
        raise ValueError(f"unknown null strategy {strategy!r}")
    if n < 2:
        return np.arange(n)
    digest = lambda text: hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
    if strategy == "circular_shift":
        low = max(1, min(min_shift, n // 2))
        high = max(low + 1, n - low + 1)
        return np.roll(np.arange(n), low + int(digest(str(seed))[:8], 16) % (high - low))
    cut = np.flatnonzero(np.diff(time) != 1) + 1
    blocks = [p[i : i + block_size] for p in np.split(np.arange(n), cut) for i in range(0, len(p), block_size)]
    return np.concatenate([blocks[i] for i in sorted(range(len(blocks)), key=lambda i: (digest(f"{seed}:{i}"), i))])
