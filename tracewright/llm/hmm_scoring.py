"""LM scoring (5): a hidden Markov model over words, trained by Baum-Welch counts summed over partitions.

A word's probability in a state is that of its class there times the word's share of the class by smoothed corpus counts. The `top_classes`
commonest words and the end are classes of their own; other words are classed by their last three bytes into `tail_classes`. Each tail class has
one place for unknown words, so the probabilities of all continuations sum to one. As a word's share of its class doesn't depend on the state,
the exact likelihood is the scaled forward recursion over classes times the shares of all words.

Words are known by 64-bit hashes. Counts are summed over all training rows. The dictionary of the commonest words, `near_words` at most, is broadcast,
a bound that doesn't depend on the data; counts of all other words are joined by shuffle, where no word is common any more. Null and
empty texts are scored as their end alone; rows repeat as often as they come in; without training rows nothing is known and the model is
that of its start. Sequences are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from ._text import Texts, mix64, slices, small_batches

END = np.uint64(0x5D1E7A3C9B2F4861)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Lowered(Texts):
    def __init__(self, column: pa.Array):
        super().__init__(column)
        self.bytes = _LOWER[self.bytes]


def _tails(t: Texts, tail_classes: int) -> np.ndarray:
    return (mix64(t.tail_hash(3)) % np.uint64(tail_classes)).astype(np.int64)


def word_counts(docs: DataFrame, tail_classes: int) -> DataFrame:
    """hash, tail class and count of each token of the training rows; the end has tail class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, c, n = h[order], c[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], c[first], np.add.reduceat(n, first)

        def rows(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000].astype(np.int32)), pa.array(n[i : i + 100_000])], ["h", "tail", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                t = _Lowered(batch.column("text"))
                ends += t.n
                h = t.word_hash()
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, _tails(t, tail_classes)[first], n))
                size += len(u)
                if size > 1_500_000:
                    held = [merged()]
                    if len(held[0][0]) > 750_000:
                        yield from rows(*held[0])
                        held = []
                    size = len(held[0][0]) if held else 0
        if held:
            yield from rows(*merged())
        if ends:
            yield from rows(np.array([END]), np.array([-1]), np.array([ends]))

    return docs.filter(~F.col("held_out")).select("text").mapInArrow(run, "h long, tail int, n long").groupBy("h").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Dictionary of the commonest words (sorted hashes, counts, classes) and the smoothed probability of each class.

    level: least count level (see least_level) of its words; it holds all words of that level and above.
    """

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_p: np.ndarray
    end_class: int
    tokens: int
    words: int
    end_count: int
    first_tail: int
    level: int

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


def _level() -> Column:
    return F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")


def least_level(words: DataFrame, most: int) -> int:
    """Words are put into levels of their count, 16 to each doubling; the least level from which on there are `most` words at most."""
    sizes = sorted(((r["level"], r["count"]) for r in words.groupBy(_level().alias("level")).count().collect()), reverse=True)  # 16 * 63 at most
    held, least = 0, (sizes[0][0] + 1 if sizes else 0)
    for level, n in sizes:
        held += n
        if held > most:
            break
        least = level
    return least


def vocabulary_of(counts: DataFrame, near_words: int, top_classes: int, tail_classes: int) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = counts.filter(F.col("tail") == -1).first()
    words = counts.filter(F.col("tail") >= 0)
    level = least_level(words, near_words)
    found = words.filter(_level() >= level).toArrow().to_pandas()  # near_words at most
    near = found.sort_values(["n", "h"], ascending=[False, True], kind="stable")
    tails = {r["tail"]: (r["n"], r["v"]) for r in counts.filter(F.col("tail") >= 0).groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # tail_classes at most
    mass, kinds = np.zeros(tail_classes), np.zeros(tail_classes)
    for tail, (n, v) in tails.items():
        mass[tail], kinds[tail] = n, v
    n, tail = near["n"].to_numpy(np.int64), near["tail"].to_numpy(np.int64)
    top = min(top_classes, len(near))
    np.subtract.at(mass, tail[:top], n[:top])
    np.subtract.at(kinds, tail[:top], 1)
    below = total["n"] + 0.1 * (total["v"] + 1)
    class_p = np.concatenate([(n[:top] + 0.1) / below, (mass + 0.1 * (kinds + 1)) / below, [((end["n"] if end else 0) + 0.1) / below]])
    classes = np.where(np.arange(len(near)) < top, np.arange(len(near)), top + tail)
    order = np.argsort(near["h"].to_numpy(np.int64).view(np.uint64))
    hashes = near["h"].to_numpy(np.int64).view(np.uint64)[order]
    return Vocabulary(hashes, n[order], classes[order].astype(np.int64), class_p, len(class_p) - 1, int(total["n"]), int(total["v"]), int(end["n"]) if end else 0, top, level)


def encoded(docs: DataFrame, v: Vocabulary, tail_classes: int) -> DataFrame:
    """Per row: its classes as unsigned 16-bit integers, sums over the words of the dictionary, and the different other words' hashes with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, near_log double, near_known long, classes binary, rare array<struct<h: long, times: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        near_log = v.log_p(v.counts)
        end_log = float(v.log_p(np.array([v.end_count]))[0])
        for whole in batches:
            for batch in slices(whole, "text"):
                t = _Lowered(batch.column("text"))
                h = t.word_hash()
                at = np.searchsorted(v.hashes, h)
                at[at == len(v.hashes)] = 0
                near = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                cls = v.first_tail + _tails(t, tail_classes)
                cls[near] = v.classes[at[near]]
                logs = np.zeros(len(h))
                logs[near] = near_log[at[near]]
                with_end = np.insert(cls, t.word_at[1:], v.end_class).astype("<u2")
                edge = t.word_at + np.arange(t.n + 1)
                raw = with_end.tobytes()
                far, of = h[~near], t.doc[~near]
                order = np.lexsort((far, of))
                far, of = far[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (far[1:] != far[:-1]) | (of[1:] != of[:-1])])) if len(far) else np.zeros(0, np.int64)
                rare = pa.StructArray.from_arrays([pa.array(far[first].view(np.int64)), pa.array(np.diff(np.append(first, len(far))))], ["h", "times"])
                rare_at = pa.array(np.searchsorted(of[first], np.arange(t.n + 1)).astype(np.int32))
                known_end = v.end_count > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(t.n_words + 1),
                        pa.array(t.per_text(logs, t.word_at) + end_log),
                        pa.array(t.per_text(near.astype(np.int64), t.word_at) + known_end),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(rare_at, rare),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "near_log", "near_known", "classes", "rare"],
                )

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


def first_guess(class_p: np.ndarray, states: int, seed: int) -> Hmm:
    """Sticky states whose emissions are the corpus's, each disturbed by seeded noise."""
    random = np.random.Generator(np.random.PCG64(seed))
    emit = class_p * np.exp(random.normal(0, 0.5, (states, len(class_p))))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def groups_of(sequences: list[np.ndarray], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of similar length, one step after the other: their places (longest first), symbols by step, and how many reach each step."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    at = 0
    while at < len(order):
        size, stop = 0, at
        while stop < len(order) and (stop == at or size + len(sequences[order[stop]]) <= most):
            size += len(sequences[order[stop]])
            stop += 1
        own = order[at:stop]
        lengths = np.array([len(sequences[i]) for i in own])
        reach = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
        flat = np.concatenate([sequences[i] for i in own]).astype(np.int64)
        step = np.concatenate([np.arange(n) for n in lengths])
        packed = np.empty(len(flat), np.int64)
        packed[(np.cumsum(reach) - reach)[step] + np.repeat(np.arange(len(own)), lengths)] = flat
        yield own, packed, reach
        at = stop


#: Steps from one scaling to the next; emissions of so many steps in a row stay far from the least double.
_UNSCALED = 4


def forward(m: Hmm, packed: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled state probabilities and scales of each step, the natural log likelihood of each sequence, and the emissions of each step.

    Probabilities are scaled to a sum of one in every _UNSCALED-th step and in each sequence's last; other steps have the scale 1.
    """
    seen = np.ascontiguousarray(m.emit.T)[packed]
    alpha, scale, ones = np.empty_like(seen), np.ones(len(packed)), np.ones(len(m.start))
    edge = np.concatenate([[0], np.cumsum(reach)])
    starts, move = edge.tolist(), np.ascontiguousarray(m.move)
    np.multiply(seen[: starts[1]], m.start, out=alpha[: starts[1]])
    for t in range(1, len(reach)):
        a, b, before = starts[t], starts[t + 1], starts[t - 1]
        now = alpha[a:b]
        np.dot(alpha[before : before + b - a], move, out=now)
        now *= seen[a:b]
        if t % _UNSCALED == 0:
            s = np.dot(now, ones, out=scale[a:b])
            now /= s[:, None]
    later = np.concatenate([reach[1:], [0]])
    last = np.concatenate([np.arange(edge[t] + k, edge[t + 1]) for t, k in enumerate(later) if k < reach[t]])
    sums = alpha[last] @ ones
    alpha[last] /= sums[:, None]
    scale[last] *= sums
    log = np.zeros(reach[0])
    for a, b in zip(starts[::_UNSCALED], starts[1::_UNSCALED], strict=False):
        log[: b - a] += np.log(scale[a:b])
    of = np.repeat(np.arange(len(reach)), reach - later)  # the step of each sequence's last symbol
    rest = of % _UNSCALED != 0
    np.add.at(log, (last - edge[of])[rest], np.log(scale[last[rest]]))
    return alpha, scale, log, seen


def expected_counts(m: Hmm, packed: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log likelihood."""
    alpha, scale, log, ahead = forward(m, packed, reach)
    ahead /= scale[:, None]
    beta, back = np.ones_like(ahead), np.ascontiguousarray(m.move.T)
    starts = [0, *np.cumsum(reach).tolist()]
    for t in range(len(reach) - 1, 0, -1):
        a, b, before = starts[t], starts[t + 1], starts[t - 1]
        now = ahead[a:b]
        now *= beta[a:b]
        np.dot(now, back, out=beta[before : before + b - a])
    previous = np.arange(reach[0], len(packed)) - np.repeat(reach[:-1], reach[1:])  # where each sequence was a step before
    moves = alpha[previous].T @ ahead[reach[0] :]
    alpha *= beta  # now the states' posteriors
    by_state = np.ascontiguousarray(alpha.T)
    emits = np.stack([np.bincount(packed, weights=w, minlength=m.emit.shape[1]) for w in by_state])
    return alpha[: reach[0]].sum(axis=0), moves * m.move, emits, float(log.sum())


def _sequences(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("classes").to_pylist()]


def _held(batches: Iterator[pa.RecordBatch], symbols: int = 4_000_000) -> Iterator[pa.Table]:
    """Batches put together up to so many symbols of two bytes, so that sequences of like length meet."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("classes").nbytes // 2
        if size >= symbols:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def trained(train: DataFrame, m: Hmm, class_p: np.ndarray, rounds: int, smooth: float = 5.0) -> Hmm:
    """Baum-Welch: each round sums every partition's expected counts; emissions are smoothed by the corpus's class probabilities."""
    states, classes = m.emit.shape
    for _ in range(rounds):
        shared = train.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + states * classes)
            for part in _held(batches):
                for _, packed, reach in groups_of(_sequences(part)):
                    a, b, c, _ = expected_counts(shared.value, packed, reach)
                    total += np.concatenate([a, b.ravel(), c.ravel()])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "x"])

        rows = train.select("classes").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow().to_pandas()  # a row for each parameter
        total = np.zeros(states + states * states + states * classes)
        total[rows["cell"].to_numpy()] = rows["x"].to_numpy()
        start, move, emit = total[:states] + 1, total[states : states + states**2].reshape(states, states) + 1, total[states + states**2 :].reshape(states, classes)
        emit = emit + smooth * states * class_p
        m = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return m


def hmm_scores(docs: DataFrame, states: int = 8, rounds: int = 4, top_classes: int = 8192, tail_classes: int = 1024, near_words: int = 1 << 17, seed: int = 5) -> DataFrame:
    """Scores of docs (doc_id, text, held_out): learns from rows that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    counts = saved(word_counts(rows, tail_classes), "word-counts")
    v = vocabulary_of(counts, near_words, top_classes, tail_classes)
    table = saved(encoded(rows, v, tail_classes), "classes")
    m = trained(table.filter(~F.col("held_out")), first_guess(v.class_p, states, seed), v.class_p, rounds)

    rare_counts = counts.filter((F.col("tail") >= 0) & (_level() < v.level)).select("h", "n")
    below = float(v.tokens + 0.1 * (v.words + 1))
    rare = table.select("row", F.inline("rare")).join(rare_counts, "h", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10((n + 0.1) / below)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"))

    shared = spark.sparkContext.broadcast((m, v.class_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, class_p = shared.value
        log_class = np.log10(class_p)
        for part in _held(batches):
            sequences = _sequences(part)
            gain = np.zeros(len(sequences))
            for own, packed, reach in groups_of(sequences):
                gain[own] = forward(model, packed, reach)[2] / np.log(10)
            gain -= [log_class[s].sum() for s in sequences]
            yield from part.drop_columns("classes").append_column("gain", pa.array(gain)).to_batches()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    gained = table.select("row", "doc_id", "held_out", "n_tokens", "near_log", "near_known", "classes").mapInArrow(run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, near_log double, near_known long, gain double")
    base = F.col("near_log") + F.coalesce("rare_log", F.lit(0.0))
    return gained.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("near_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


def op5_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return hmm_scores(docs.withColumn("held_out", held_out))
