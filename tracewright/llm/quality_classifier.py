"""Quality classifier (9): a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Boosted trees of small depth are grown on a sample of labelled rows; every path from a root is a conjunctive rule. A logistic model with an
L1 penalty weighs rules and the statistics themselves; most weights become zero. What is left is one SQL expression, so scoring runs in
generated code over the statistics of every whole text.

The sample has at most sample_rows labelled rows (those with the smallest hash of their id); nothing else is sampled. Without labels of
both kinds the score is the smoothed share of label 1 (0.5 without labels). Null and empty texts have zero statistics and a score like any
other; repeated rows get equal scores; ids that repeat with different texts are learned from once; null labels are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from ._text import Texts, slices, small_batches
from .quality_rules import statistics

FEATURES = ("log_words", "mean_word", "symbols", "uppercase", "digits", "exclamations", "bars", "stops", "commas", "wide", "dup_lines", "repeats", "distinct", "words_a_line", "urls")
_CLASS = {name: np.isin(np.arange(256), list(chars.encode())).astype(np.int64) for name, chars in {"exclamations": "!", "bars": "|", "stops": ".", "commas": ",", "urls": "/@"}.items()}
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), range(a, b)).astype(np.int64) for a, b in ((65, 91), (97, 123), (48, 58)))
_WIDE = (np.arange(256) >= 0xC0).astype(np.int64)


def features(t: Texts) -> dict[str, np.ndarray]:
    hashes = t.word_hash()
    s = statistics(t, hashes)
    share = lambda a, b: np.divide(a, b, out=np.zeros(t.n), where=b > 0)
    words, upper, lower = s["n_words"], t.per_text(_UPPER[t.bytes]), t.per_text(_LOWER[t.bytes])
    _, first = np.unique(t.in_doc(hashes, t.doc), return_index=True)
    lines = t.per_text((t.bytes == 10).astype(np.int64)) + 1
    out = {
        "log_words": np.log1p(words), "mean_word": share(s["word_chars"], words), "symbols": share(s["n_symbols"], words), "uppercase": share(upper, upper + lower),
        "digits": share(t.per_text(_DIGIT[t.bytes]), s["word_chars"]), "wide": share(t.per_text(_WIDE[t.bytes]), s["word_chars"]), "dup_lines": share(s["n_dup_lines"], lines),
        "repeats": share(s["n_repeat_words"], words), "distinct": share(np.bincount(t.doc[first], minlength=t.n), words), "words_a_line": share(words, lines),
    }
    return {k: np.asarray(v, float) for k, v in (out | {k: share(t.per_text(c[t.bytes]), words) for k, c in _CLASS.items()}).items()}


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with a double column for each of FEATURES (replacing columns of those names)."""
    small_batches(docs.sparkSession)
    rest = docs.drop(*FEATURES)
    kept = [c for c in rest.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text), *(f"{n} double" for n in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found = features(Texts(batch.column(text)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[n]) for n in FEATURES)], [*kept, *FEATURES])

    return rest.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all of which hold


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[float, int, float] | None:
    best = None
    total, weight = grad.sum(), hess.sum()
    for f, thresholds in enumerate(cuts):
        if not len(thresholds):
            continue
        place = np.searchsorted(thresholds, x[:, f], side="left")
        g, h, n = (np.bincount(place, weights=w, minlength=len(thresholds) + 1)[:-1].cumsum() for w in (grad, hess, np.ones(len(x))))
        gain = g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
        gain[(n < least) | (len(x) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float(thresholds[k]))
    return best


def grown_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3, bins: int = 32, seed: int = 9) -> list[Rule]:
    """All root paths of boosted trees, each grown on half of the rows."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [c[c < x[:, i].max()] for i, c in enumerate(cuts)]
    margin, rules = np.zeros(len(y)), {}
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        part = random.permutation(len(y))[: max(2, len(y) // 2)]
        stack: list[tuple[np.ndarray, np.ndarray, Rule]] = [(part, np.arange(len(y)), ())]
        while stack:
            own, all_own, path = stack.pop()
            found = _split(x[own], grad[own], hess[own], cuts, max(5, len(y) // 500)) if len(path) < depth and len(own) > 20 else None
            if found is None:
                margin[all_own] += rate * grad[own].sum() / (hess[own].sum() + 1)
                continue
            _, f, cut = found
            for above in (False, True):
                rule = (*path, (f, above, cut))
                rules.setdefault(tuple(sorted(rule)), None)
                stack.append((own[(x[own, f] > cut) == above], all_own[(x[all_own, f] > cut) == above], rule))
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.all([(x[:, f] > cut) == above for f, above, cut in rule], axis=0)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * |weights|, by accelerated proximal gradient."""
    n, m = z.shape
    step = 4 / (np.linalg.norm(z.T @ z / n, 2) + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        moved = v - step * (z.T @ r) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b, new_t = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return b, w


class RuleEnsemble:
    """Weighted rules and clipped statistics; expression() is its score as a Spark column."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]], linear: list[tuple[int, float, float, float]]):
        self.intercept, self.rules, self.linear = intercept, rules, linear

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(float(np.log(p / (1 - p))), [], [])
        rules = grown_rules(x, y, trees, depth)
        on = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
        low, high = np.quantile(x, [0.025, 0.975], axis=0)
        flat = np.clip(x, low, high)
        scale_rules, scale_flat = on.std(axis=0), flat.std(axis=0)
        scale_rules[scale_rules == 0], scale_flat[scale_flat == 0] = np.inf, np.inf
        z = np.concatenate([(on - on.mean(axis=0)) / scale_rules, 0.4 * (flat - flat.mean(axis=0)) / scale_flat], axis=1)
        b, w = lasso_logistic(z, y, penalty)
        of_rules, of_flat = w[: len(rules)] / scale_rules, 0.4 * w[len(rules) :] / scale_flat
        b -= float((of_rules * on.mean(axis=0)).sum() + (of_flat * flat.mean(axis=0)).sum())
        return cls(b, [(r, float(k)) for r, k in zip(rules, of_rules, strict=True) if k], [(f, float(low[f]), float(high[f]), float(k)) for f, k in enumerate(of_flat) if k])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = self.intercept + sum((k * holds(r, x) for r, k in self.rules), np.zeros(len(x))) + sum((k * np.clip(x[:, f], a, b) for f, a, b, k in self.linear), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))

    def expression(self, names: tuple[str, ...] = FEATURES) -> Column:
        total = F.lit(self.intercept)
        for f, low, high, k in self.linear:
            total = total + F.lit(k) * F.greatest(F.least(F.col(names[f]), F.lit(high)), F.lit(low))
        for rule, k in self.rules:
            total = total + F.when(reduce(lambda a, b: a & b, [(F.col(names[f]) > cut) if above else (F.col(names[f]) <= cut) for f, above, cut in rule]), k).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of an id as decimal text (null: of no text) modulo n."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def fitted_on(table: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> RuleEnsemble:
    """Fits on at most sample_rows of the labels (doc_id and `label`), whose statistics are in table."""
    sample = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    met = table.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f"), F.max("_label").alias("y")).orderBy("doc_id")
    found = met.select("f.*", "y").toPandas()  # sample_rows at most
    return RuleEnsemble.fitted(found[list(FEATURES)].to_numpy(float), found["y"].to_numpy(float))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    table = saved(with_features(docs), "features")
    model = fitted_on(table, labels.filter(crc_mod(F.col("doc_id"), 5) != 0), "quality", sample_rows=20_000)
    scored = table.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), model.expression().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
