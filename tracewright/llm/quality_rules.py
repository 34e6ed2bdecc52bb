"""Quality rules (4): word statistics of a text, and its maximal repeated substrings by suffix array.

The suffix array is over words. It is built by prefix doubling for all texts of a batch at once, sorting only suffixes that still share
their rank with another. Equal ranks at the doubling levels give the longest common prefix of neighbours in it. Every maximal repeated
substring of min_words words or more is an interval of that array; the union of all their spans is the union, over suffixes, of the
suffix's longest prefix that occurs elsewhere in the text. A text fails if that union covers more than max_covered of its words, or if
its longest repeat has more than max_longest words. Null or empty texts have no words and fail the base rule. Texts are never cut; a row
depends on its own text only, so repeated rows get equal verdicts, and columns of any name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Texts, slices, small_batches

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("covered_words", T.LongType()),
        T.StructField("longest_repeat", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))),
        T.StructField("kept", T.BooleanType()),
    ]
)


def duplicated_lines(t: Texts) -> np.ndarray:
    starts, ends, doc = t.lines()
    full = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends, doc = starts[full], ends[full], doc[full]
    _, first = np.unique(t.in_doc(t.span_hash(starts, ends), doc), return_index=True)
    return np.bincount(doc, minlength=t.n) - np.bincount(doc[first], minlength=t.n)


def repeated_words(t: Texts, hashes: np.ndarray, n: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of n words found twice or more in it."""
    grams, at = t.ngrams(n, hashes)
    keys = t.in_doc(grams, t.doc[at])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, at[hit], 1)
    np.add.at(steps, at[hit] + n, -1)
    return t.per_text((np.cumsum(steps)[:-1] > 0).astype(np.int64), t.word_at)


def longest_repeats(keys: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each suffix the words of its longest prefix that begins another suffix too.

    keys: symbols, equal only for equal words of one text; stop: where each symbol's text ends.
    """
    n = len(keys)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order = np.argsort(keys)
    heads = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    head_at = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head_at
    suffixes = order.copy()
    levels, k = [rank.copy()], 1
    shared = np.bincount(rank, minlength=n)
    active = np.flatnonzero(shared[rank] > 1)
    while len(active):
        next_rank = np.zeros(len(active), np.int64)
        inside = active + k < stop[active]
        next_rank[inside] = rank[active[inside] + k] + 1
        pair = rank[active] * (n + 2) + next_rank
        by = np.argsort(pair)
        active, pair = active[by], pair[by]
        old = rank[active]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        place = old + np.arange(len(active)) - np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        new = place[np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))]
        suffixes[place] = active
        rank[active] = new
        k *= 2
        alone = first & np.concatenate([first[1:], [True]])
        active = active[~alone]
        if len(active):
            levels.append(rank.copy())
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        step = same * (1 << level)
        common += step
        a += step
        b += step
    best[suffixes[:-1]] = common
    best[suffixes[1:]] = np.maximum(best[suffixes[1:]], common)
    return best


def statistics(t: Texts, hashes: np.ndarray) -> dict[str, np.ndarray]:
    points = np.concatenate([[0], np.cumsum((t.bytes & 0xC0) != 0x80)])
    return {
        "n_words": t.n_words,
        "word_chars": t.per_text(points[t.ends] - points[t.starts], t.word_at),
        "n_symbols": t.per_text(_SYMBOL[t.bytes]),
        "n_dup_lines": duplicated_lines(t),
        "n_repeat_words": repeated_words(t, hashes),
    }


def judged(column: pa.Array, min_words: int, max_covered: float, max_longest: int) -> pa.StructArray:
    t = Texts(column)
    hashes = t.word_hash()
    out = statistics(t, hashes)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    best = longest_repeats(t.in_doc(hashes, t.doc), np.repeat(t.word_at[1:], t.n_words))
    out["longest_repeat"] = np.zeros(t.n, np.int64)
    np.maximum.at(out["longest_repeat"], t.doc, best)
    at = np.arange(len(best))
    reach = np.maximum.accumulate(np.where(best >= min_words, at + best, 0)) if len(best) else at
    covered = reach > at  # a suffix's repeat never reaches into the next text
    out["covered_words"] = t.per_text(covered.astype(np.int64), t.word_at)
    begin = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | (t.doc[1:] != t.doc[:-1])])) if len(best) else at
    end = np.flatnonzero(covered & np.concatenate([~covered[1:] | (t.doc[1:] != t.doc[:-1]), [True]])) + 1 if len(best) else at
    spans = pa.StructArray.from_arrays([pa.array(begin - t.word_at[t.doc[begin]], pa.int64()), pa.array(end - begin, pa.int64())], ["start", "words"])
    out["spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, t.word_at).astype(np.int32)), spans)
    out["kept"] = ~out["base_failed"] & (out["covered_words"] <= max_covered * out["n_words"]) & (out["longest_repeat"] <= max_longest)
    return pa.StructArray.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x) for f in VERDICT], [f.name for f in VERDICT])


def quality_rules(docs: DataFrame, text: str = "text", verdict: str = "quality_verdict", min_words: int = 6, max_covered: float = 0.3, max_longest: int = 200) -> DataFrame:
    """docs with one struct column more (named by `verdict`, replacing one of that name) with the fields of VERDICT."""
    small_batches(docs.sparkSession)
    rest = docs.drop(verdict)
    names = rest.columns
    numbers = [f"c{i}" for i in range(len(names))]
    place = names.index(text)
    rows = rest.toDF(*numbers)
    schema = T.StructType([*rows.schema.fields, T.StructField("verdict", VERDICT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, numbers[place]):
                found = judged(batch.column(place), min_words, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*numbers, "verdict"])

    return rows.mapInArrow(run, schema).toDF(*names, verdict)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    v = "quality_verdict"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]
    return quality_rules(docs).select("doc_id", *(F.col(f"{v}.{n}") for n in names))
