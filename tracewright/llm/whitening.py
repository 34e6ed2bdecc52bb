"""Embedding whitening (12): principal components of unit variance from an exact scatter matrix.

Entries become integers floor(scale * c) + offset. The fit list holds each different integer vector once. Its scatter is summed exactly by
residues: each task multiplies the residues of its rows, less an integer near the mean, modulo several primes with ordinary matrix products
(sums stay under 2**53), tasks' sums are added up and the Chinese remainder theorem gives back the integers. So many primes are used that their
product exceeds twice the largest sum that can occur. A constant column beside each vector brings the sums and the number of rows along.
Covariances follow from these integers as fractions, rounded once, and their eigenvectors in double precision.

Rows whose vector is null or holds null or non-finite entries are dropped; an empty vector has no component and so no rows. Vectors of each length
are whitened by themselves (most_lengths at most, else an error), of at most most_dimensions entries, as the covariance is decomposed on the
driver. Repeated rows count once in the fit and each get their own result; ids play no part. A direction without variance (one vector only,
copies of a column) has an eigenvalue within rounding of 0: its `whitened` is null and it counts in no error; `explained` is null where the trace
is 0. Entries whose integer lies outside of +-2**52 raise an error. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved

#: Rows multiplied at once: residues of either sign under PRIME_BELOW / 2 keep sums under 2**53.
ROWS_AT_ONCE = 4096
PRIME_BELOW = 1 << 21
LARGEST = float(1 << 52)


def primes_over(bound: int) -> list[int]:
    """The largest primes under PRIME_BELOW, as many as their product needs to exceed the bound."""
    out, product, n = [], 1, PRIME_BELOW - 1
    while product <= bound:
        if all(n % q for q in range(3, int(n**0.5) + 1, 2)):
            out.append(n)
            product *= n
        n -= 2
    return out


def from_residues(residues: list[int], primes: list[int]) -> int:
    """The integer nearest to 0 with these residues (Garner's mixed digits)."""
    x, product = 0, 1
    for r, p in zip(residues, primes, strict=True):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x if 2 * x < product else x - product


@dataclass
class Whitening:
    """Of vectors of one length: the integer center, n, exact sums of x, components in rows, eigenvalues, trace and, once known, the error."""

    center: np.ndarray
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    rank: int
    error: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) projected on each component, over its deviation; NaN beyond the rank."""
        shift = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.center, strict=True)])
        projected = ((x - self.center).astype(float) - shift) @ self.components.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.arange(len(self.values)) < self.rank, projected / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)**2, exact."""
        shift = [s - self.n * int(c) for s, c in zip(self.sums, self.center, strict=True)]
        y = x - self.center
        widest = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, shift), default=0)
        if widest**2 * x.shape[1] < 2**63:
            return ((self.n * y - np.array(shift, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * a - b) ** 2 for a, b in zip(row, shift, strict=True)) for row in y.tolist()]


def integers(vector: Column, scale: float, offset: int) -> Column:
    """floor(scale * entry) + offset of each entry as long; null where the vector is null or holds null or non-finite entries."""
    v = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fits = F.forall(v, lambda c: F.abs(c * scale) + abs(offset) < LARGEST)
    whole = F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long"))
    return F.when(F.coalesce(finite, F.lit(False)), F.when(fits, whole).otherwise(F.raise_error(F.lit("an entry is too large to be whitened"))))


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of one length, ROWS_AT_ONCE at most: the length, the vectors as a matrix, and the rows themselves."""
    for batch in batches:
        sizes = np.diff(batch.column(column).offsets.to_numpy())
        for d in np.unique(sizes[sizes > 0]):
            own = batch.take(pa.array(np.flatnonzero(sizes == d)))
            for at in range(0, own.num_rows, ROWS_AT_ONCE):
                part = own.slice(at, ROWS_AT_ONCE)
                yield int(d), part.column(column).flatten().to_numpy().reshape(-1, d), part


def extents(fit: DataFrame) -> DataFrame:
    """d, pos, rows, mean (rounded; only a center), least and largest x of each dimension of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for d, x, _ in _blocks(batches):
            n, total, low, high = held.get(d, (0, np.zeros(d), np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)))
            held[d] = (n + len(x), total + x.sum(axis=0, dtype=float), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
        for d, (n, total, low, high) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(total), pa.array(low), pa.array(high)], ["d", "pos", "n", "total", "low", "high"])

    sums = fit.mapInArrow(run, "d long, pos long, n long, total double, low long, high long").groupBy("d", "pos")
    return sums.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def residue_sums(fit: DataFrame, centers: dict[int, np.ndarray], primes: list[int]) -> DataFrame:
    """d, cell (of the upper triangle of the scatter of [x - center, 1], row after row) and its sum modulo each prime in an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, x, _ in _blocks(batches):
            y = np.column_stack([x - centers[d], np.ones(len(x), np.int64)])
            total = held.setdefault(d, np.zeros((len(primes), d + 1, d + 1), np.int64))
            for k, p in enumerate(primes):
                r = y % p
                r = np.where(r > p // 2, r - p, r).astype(float)
                total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        for d, total in held.items():
            upper = total[:, *np.triu_indices(d + 1)]
            for at in range(0, upper.shape[1], 100_000):
                part = upper[:, at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.shape[1], d)), pa.array(at + np.arange(part.shape[1])), *map(pa.array, part)], names)

    names = ["d", "cell", *(f"r{k}" for k in range(len(primes)))]
    cells = fit.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return cells.groupBy("d", "cell").agg(*((F.sum(f"r{k}") % p).alias(f"r{k}") for k, p in enumerate(primes)))


def decomposed(center: np.ndarray, scatter: list[list[int]], components: int) -> Whitening:
    """From the exact scatter of [x - center, 1]."""
    d, n = len(center), scatter[-1][-1]
    sums = [scatter[i][d] for i in range(d)]
    covariance = np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])  # integers; one rounding
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    trace = sum(n * scatter[i][i] - sums[i] ** 2 for i in range(d)) / (n * n)
    rank = int((values > d * np.finfo(float).eps * max(values[0], 0)).sum())
    k = min(components, d)
    return Whitening(center, n, [s + n * int(c) for s, c in zip(sums, center, strict=True)], vectors[:k], values[:k], trace, min(rank, k))


def fitted(fit: DataFrame, components: int, most_lengths: int, most_dimensions: int) -> dict[int, Whitening]:
    """The whitening of each length of the fit list (x: array of long, each vector once)."""
    widths = [r["d"] for r in fit.select(F.size("x").alias("d")).filter("d > 0").distinct().limit(most_lengths + 1).collect()]
    if len(widths) > most_lengths or max(widths, default=0) > most_dimensions:
        raise ValueError(f"vectors of more than {most_lengths} lengths or of more than {most_dimensions} entries")
    if not widths:
        return {}
    found: dict[int, list] = {}
    for r in extents(fit).collect():  # a row for each dimension
        found.setdefault(r["d"], []).append(r)
    centers, bound = {}, 1
    for d, rows in found.items():
        rows.sort(key=lambda r: r["pos"])
        centers[d] = np.array([round(r["mean"]) for r in rows], np.int64)
        widest = max(max(r["high"] - c, c - r["low"], 1) for r, c in zip(rows, centers[d].tolist(), strict=True))
        bound = max(bound, rows[0]["n"] * widest**2)
    primes = primes_over(2 * bound)
    table = residue_sums(fit, centers, primes).orderBy("d", "cell").toArrow()  # a row for each pair of dimensions
    out, at = {}, np.asarray(table.column("d"))
    for d in sorted(centers):
        own = table.filter(pa.array(at == d))
        columns = [own.column(f"r{k}").to_pylist() for k in range(len(primes))]
        scatter = [[0] * (d + 1) for _ in range(d + 1)]
        for i, j, *residues in zip(*np.triu_indices(d + 1), *columns, strict=True):
            scatter[i][j] = scatter[j][i] = from_residues(residues, primes)
        out[d] = decomposed(centers[d], scatter, components)
    return out


def measure_errors(fit: DataFrame, models: dict[int, Whitening]) -> None:
    """Sets each whitening's error: the largest absolute entry of the covariance of the fit list's whitened vectors minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, x, _ in _blocks(batches):
            w = models[d]
            z = np.column_stack([w.scores(x)[:, : w.rank], np.ones(len(x))])  # centered by S / n before it is projected
            held[d] = held.get(d, 0) + z.T @ z
        for d, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, d)), pa.array(np.arange(total.size)), pa.array(total.ravel())], ["d", "cell", "total"])

    sums: dict[int, list] = {}
    for r in fit.mapInArrow(run, "d long, cell long, total double").groupBy("d", "cell").agg(F.sum("total").alias("total")).orderBy("d", "cell").collect():  # components squared
        sums.setdefault(r["d"], []).append(r["total"])
    for d, w in models.items():
        total = np.array(sums[d]).reshape(w.rank + 1, w.rank + 1)
        mean = total[:-1, -1] / w.n
        w.error = float(np.abs(total[:-1, :-1] / w.n - np.outer(mean, mean) - np.eye(w.rank)).max(initial=0.0))


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0, offset: int = 1_000_000, most_lengths: int = 16, most_dimensions: int = 2048) -> DataFrame:
    """A row for each kept row and component: vec_id, component (from 1, by falling eigenvalue), n, deviation (exact, decimal(38, 0); null beyond),
    whitened, explained and identity_error (one value for each length)."""
    x = integers(F.col(f"`{vector}`"), scale, offset)
    kept = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull())
    fit = saved(kept.select("x").distinct(), "fit-list")
    models = fitted(fit, components, most_lengths, most_dimensions)
    measure_errors(fit, models)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, own in _blocks(batches):
            w = shared.value[d]
            k = len(w.values)
            each = np.repeat(np.arange(len(x)), k)
            deviations = [Decimal(v) if v < 10**38 else None for v in w.deviations(x)]
            scores = w.scores(x).ravel()
            explained = w.values / w.trace if w.trace > 0 else np.full(k, np.nan)
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), w.n)),
                    pa.array(deviations, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(scores, mask=np.isnan(scores)),
                    pa.array(np.tile(explained, len(x)), mask=np.tile(np.isnan(explained), len(x))),
                    pa.array(np.full(len(each), w.error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    id_type = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
