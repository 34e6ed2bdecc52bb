"""Words, lines and n-grams of whole Arrow text batches as numpy arrays, without a Python loop over words.

A word is a run of bytes other than space and 0x09-0x0D; in UTF-8 these never lie inside a character. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D | 1
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of x (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 .. n - 1, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))])
            tables.append(p)
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long: keeps the Arrow batches between the JVM and Python at a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task and would hold the peak of all its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    at = offsets_of(batch.column(column))[0]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def offsets_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return at, column


class Texts:
    """The texts of one Arrow column: bytes, words and their hashes, computed when first asked for."""

    def __init__(self, column: pa.Array):
        at, column = offsets_of(column)
        raw = column.buffers()[2] if len(column) else None
        self.n = len(column)
        self.bytes = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        word = ~_SPACE[self.bytes]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = self.at[1:] > self.at[:-1]
        begin, end = self.at[:-1][full], self.at[1:][full] - 1
        first[begin], last[end] = word[begin], word[end]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i are word_at[i] .. word_at[i + 1] - 1
        self.word_at = np.searchsorted(self.starts, self.at)
        self.n_words = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self._sums: np.ndarray | None = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span, equal for equal contents."""
        power, inverse = _power_tables(len(self.bytes) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(_VALUES[self.bytes] * power[: len(self.bytes)], out=self._sums[1:])
        return mix64((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def tail_hash(self, n: int) -> np.ndarray:
        """Hash of the last n bytes of each word (all of a shorter one)."""
        return self.span_hash(np.maximum(self.starts, self.ends - n), self.ends)

    def ngrams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words that lie in one text, and each window's first word."""
        h = self.word_hash() if hashes is None else hashes
        left = np.repeat(self.word_at[1:], self.n_words) - np.arange(len(h))
        at = np.flatnonzero(left >= n)
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total = (total ^ h[at + j]) * _ODD + np.uint64(j + 1)
        return mix64(total), at

    def per_text(self, flags: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums of flags (one for each byte, or word if at is word_at) over each text."""
        at = self.at if at is None else at
        total = np.zeros(len(flags) + 1, np.int64 if flags.dtype != np.float64 else np.float64)
        np.cumsum(flags, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    def in_doc(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Keys that are equal only for equal hashes in the same text."""
        return mix64(h + mix64((doc.astype(np.uint64) + np.uint64(1)) * _ODD))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line."""
        breaks = np.flatnonzero(self.bytes == 10)
        starts = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.at[1:], breaks]), kind="stable")
        per = np.diff(np.searchsorted(breaks, self.at)) + 1
        return starts, ends, np.repeat(np.arange(self.n), per)


def crc_of_id(ids: pa.Array) -> np.ndarray:
    """crc32 of each id as decimal text; 0 (that of an empty text) for null."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()), np.int64, len(ids))
