"""Language ID (10): text likelihood, declared language, address suffix and host prior, fused by Bayes' rule.

Text: how often words with each ending (their last four bytes, hashed into `buckets`) occur in documents that declare each language,
counted over all rows; a row's own words are taken out of the counts of the language that it declares. Declared language: right with probability `reliability`. Prior of a host: its documents' declared languages, smoothed
towards those of its address suffix, which are smoothed towards those of all rows; a row's own declaration is taken out of both. All counts are
grouped aggregations; hosts that hold many rows are joined by a join that deals out their rows.

The languages are all that are declared: their counts are kept only where they aren't zero, a row's likelihood is one number for each. Over
most_languages of them, or most_cells counts that aren't zero, raise an error, as each task holds these counts. A row is rejected (kept is false) if it has no word or if its best language has
a posterior under `least_posterior`; without any declared language at all, every row is. Null texts have no words, null declarations and hosts are no evidence for a
language (null hosts form one host). Ties go to the language declared more often. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import saved
from ._names import quoted
from ._skew import lookup, never_null
from ._text import Texts, mix64, slices, small_batches


def _buckets_of(t: Texts, buckets: int) -> np.ndarray:
    return (mix64(t.tail_hash(4)) % np.uint64(buckets)).astype(np.int64)


def ending_counts(docs: DataFrame, languages: list[str], buckets: int, at_once: int = 1 << 20, most_cells: int = 1 << 25) -> tuple[np.ndarray, np.ndarray]:
    """Cells (place of the language * buckets + bucket) that occur, in order, and the words of each. Tasks hold at_once or so at a time."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, new = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            at, inverse = np.unique(np.concatenate([cells, *(c for c, _ in new)]), return_inverse=True)
            total = np.zeros(len(at), np.int64)
            np.add.at(total, inverse, np.concatenate([n, *(k for _, k in new)]))
            return at, total

        for whole in batches:
            for batch in slices(whole, "_text"):
                t = Texts(batch.column("_text"))
                lang = np.array([place.get(x, -1) for x in batch.column("_lang").to_pylist()], np.int64)[t.doc]
                known = lang >= 0
                new.append(np.unique(lang[known] * buckets + _buckets_of(t, buckets)[known], return_counts=True))
                if sum(len(c) for c, _ in new) > at_once:
                    (cells, n), new = merged(), []
                    if len(cells) > at_once:
                        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])
                        cells, n = cells[:0], n[:0]
        cells, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    out = docs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).limit(most_cells + 1).toArrow()  # pairs of language and bucket that occur
    if out.num_rows > most_cells:
        raise ValueError(f"more than {most_cells} counts of languages' endings")
    cells, n = (out.column(c).to_numpy() for c in ("cell", "n"))
    order = np.argsort(cells)
    return cells[order], n[order]


def _suffix_of(host: str, suffix: Column | None) -> Column:
    """The host's last label, without user and port; empty for hosts of one label and for addresses in numbers."""
    if suffix is not None:
        return F.coalesce(suffix, F.lit(""))
    name = F.regexp_replace(F.coalesce(F.col(quoted(host)), F.lit("")), r"^.*@|:\d*$", "")
    return F.regexp_extract(name, r"\.(?!\d+$)([^.:\]]*)$", 1)


def _dense(of: str, n: int) -> Column:
    """The counts of entries (at, n) as an array over all n languages."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(F.col(f"{of}.n"), F.array_position(F.col(f"{of}.at"), i).cast("int") - 1), F.lit(0)).cast("double"))


def _total(of: str) -> Column:
    return F.aggregate(f"{of}.n", F.lit(0.0), lambda a, n: a + n)


def language_id(
    docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", suffix: Column | None = None, reliability: float = 0.9, strength: float = 20.0,
    buckets: int = 1 << 15, least_posterior: float = 0.6, most_languages: int = 2000,
) -> DataFrame:
    """All columns of docs but text, with language, posterior and kept (replacing columns of those names)."""
    spark, names = docs.sparkSession, ["language", "posterior", "kept"]
    small_batches(spark)
    rest = docs.drop(*names)
    columns = [c for c in rest.columns if c != text]
    of = lambda c: rest[quoted(c)]
    said = rest.select(of(declared).alias("l")).filter("l IS NOT NULL").groupBy("l").count()
    often = said.orderBy(F.desc("count"), "l").limit(most_languages + 1).collect()
    if len(often) > most_languages:
        raise ValueError(f"more than {most_languages} declared languages")
    languages, total = [r["l"] for r in often], sum(r["count"] for r in often)
    if not languages:
        return rest.select(*map(of, columns), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    cells, n = ending_counts(rest.select(of(text).alias("_text"), of(declared).alias("_lang")), languages, buckets)
    owner = cells // buckets
    words = np.bincount(owner, weights=n, minlength=len(languages)) + 0.5 * buckets
    shared = spark.sparkContext.broadcast((np.searchsorted(owner, np.arange(len(languages) + 1)), (cells % buckets).astype(np.int32), n, words))  # the buckets of each language and their counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bucket, n, words = shared.value
        place = {x: i for i, x in enumerate(languages)}
        for whole in batches:
            for batch in slices(whole, "_text"):
                t = Texts(batch.column("_text"))
                at = _buckets_of(t, buckets)
                own = np.array([place.get(x, -1) for x in batch.column("_declared").to_pylist()], np.int64)
                pairs, times = np.unique(t.doc * buckets + at, return_counts=True)
                of_pair = pairs // buckets
                likelihood = np.empty((batch.num_rows, len(languages)))
                for k, all_words in enumerate(words):
                    count = np.zeros(buckets)
                    count[bucket[starts[k] : starts[k + 1]]] = n[starts[k] : starts[k + 1]]
                    likelihood[:, k] = t.per_text(np.log10((count + 0.5) / all_words)[at], t.word_at)
                    mine = np.flatnonzero(own == k)
                    if len(mine):  # without the row's own words
                        use = own[of_pair] == k
                        logs = times[use] * np.log10((count[pairs[use] % buckets] - times[use] + 0.5) / (all_words - t.n_words[of_pair[use]]))
                        likelihood[mine, k] = np.bincount(of_pair[use], weights=logs, minlength=batch.num_rows)[mine]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(languages), pa.int32()), pa.array(likelihood.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(t.n_words), lists, pa.array(own, pa.int32())], [*kept, "_words", "_likelihood", "_own"])

    said_languages = F.array(*map(F.lit, languages))
    keyed = rest.select(never_null(of(host)).alias("_host"), _suffix_of(host, suffix).alias("_suffix"), of(declared).alias("_lang"))
    counted = keyed.groupBy("_host", "_suffix", "_lang").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.array_position(said_languages, F.col("_lang")).cast("int") - 1)
    entries = lambda n: F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.expr(n).alias("n"))))
    by_host = counted.groupBy("_host", "_suffix").agg(entries("n").alias("_entries"), F.sum("n").alias("_rows"))
    by_host = by_host.select(F.concat_ws("\x00", "_host", "_suffix").alias("_key"), "_suffix", "_entries", "_rows")
    each = by_host.select("_suffix", F.posexplode_outer("_entries").alias("_nth", "_entry")).groupBy("_suffix", F.col("_entry.at").alias("at")).agg(F.sum("_entry.n").alias("n"), F.count_if(F.coalesce("_nth", F.lit(0)) == 0).alias("_hosts"))
    by_suffix = each.groupBy("_suffix").agg(entries("n").alias("_entries"), F.sum("_hosts").alias("_hosts"))
    by_suffix = by_suffix.select("_suffix", _dense("_entries", len(languages)).alias("_of_suffix"), _total("_entries").alias("_in_suffix"), "_hosts")
    by_host = by_host.select("_key", "_suffix", _dense("_entries", len(languages)).alias("_of_host"), _total("_entries").alias("_in_host"), "_rows")
    hosts = lookup(by_host, by_suffix, "_suffix", "_hosts", "_key").select("_key", "_of_host", "_in_host", "_of_suffix", "_in_suffix", "_rows")

    # the caller's columns go by number in between, so that no name of theirs meets one of ours
    key = F.concat_ws("\x00", never_null(of(host)), _suffix_of(host, suffix))
    numbered = rest.select(*(of(c).alias(f"c{i}") for i, c in enumerate(columns)), key.alias("_key"), of(text).alias("_text"), of(declared).alias("_declared"))
    kept = [*(f"c{i}" for i in range(len(columns))), "_key"]
    scored = numbered.mapInArrow(run, T.StructType([*(numbered.schema[c] for c in kept), *T._parse_datatype_string("_words long, _likelihood array<double>, _own int").fields]))
    scored = scored.withColumn("_spread", F.xxhash64("_words", "_likelihood"))
    met = lookup(scored, hosts, "_key", "_rows", "_spread")
    own, base = F.col("_own"), F.array(*(F.lit(r["count"] / total) for r in often))
    wrong = (1 - reliability) / max(1, len(languages) - 1)
    declares = lambda i: F.when(own < 0, F.lit(0.0)).when(i == own, F.log10(F.lit(reliability))).otherwise(F.log10(F.lit(wrong)))
    less = lambda c, i: F.get(c, i) - F.when(i == own, 1.0).otherwise(0.0)
    others = lambda c: F.col(c) - F.when(own < 0, 0.0).otherwise(1.0)
    smoothed = lambda n, prior, all: (n + F.lit(strength) * prior) / (all + F.lit(strength))
    prior = lambda i: smoothed(less("_of_host", i), smoothed(less("_of_suffix", i), F.get(base, i), others("_in_suffix")), others("_in_host"))
    evidence = F.transform("_likelihood", lambda a, i: a + declares(i) + F.log10(prior(i)))
    fused = met.withColumn("_evidence", evidence).withColumn("_best", F.array_max("_evidence"))
    share = F.lit(1.0) / F.aggregate("_evidence", F.lit(0.0), lambda a, e: a + F.pow(F.lit(10.0), e - F.col("_best")))
    language = F.element_at(said_languages, F.array_position("_evidence", F.col("_best")).cast("int"))
    judged = fused.select(*kept, language.alias("language"), share.alias("posterior"), ((F.col("_words") > 0) & (share >= least_posterior)).alias("kept"))
    return judged.select(*(judged[f"c{i}"].alias(c) for i, c in enumerate(columns)), "language", "posterior", "kept")  # a step of its own: new names never meet the lambdas above


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return language_id(docs).select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "kept")


def op10_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: markup's lang attribute, address suffix and host; tags are taken out of the text.

    Null html has no words and no declaration, a null url or one without `://` the empty host.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.coalesce(F.col("html"), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select("page_id", plain.alias("text"), F.when(declared != "", F.lower(declared)).alias("lang"), host.alias("source"))
    return language_id(rows).select("page_id", "language", F.round("posterior", 6).alias("posterior"), "kept")
