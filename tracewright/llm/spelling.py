"""Spelling variant grouping (11): words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter (letters beyond a-z share the bits of their kind): 1 where the word has that letter an odd number of
times. One inserted, deleted or replaced letter flips two bits at most, so of three bands of bits one at least stays equal. Words meet by a join
on an equal band and on the length of the shorter word, and are verified by edit distance within the join, so that it only ever makes rows of
near words.

Bands of few letters are alike for many words. One edit also leaves the first or the last half of the shorter word as it is; each word
therefore meets once by a band with its first half and once by a band with its last, which splits common bands without losing a pair. A pair
comes from the first band and half that it shares, so no pair comes twice and nothing has to be made distinct.

Words are counted over whole texts by one aggregation. Bits are dealt to the bands in turns by how common letters are (`LETTERS`), which only
evens out the bands. Roots follow by doubling: every word's chain of forms grows by a factor of `ratio` in n at each step, so its length is at
most the logarithm of the largest n, and half as many joins as its bits are enough, each written to the shared folder. Every join is by shuffle:
words are small as files but many as rows, so a broadcast of them would go through the driver.

Null texts have no words, empty ones neither; repeated rows count as often as they come in; a null id counts as an empty one. Ties of n go to the word that
comes first by code points. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved

#: Letters a-z, common ones first: the n-th is bit n, and bit n belongs to band n % 3.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
BANDS = 3
#: Bits of all other letters, by code point.
OTHER_BITS = 34
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, doc_id: str, text: str, shortest: int, damage: int) -> DataFrame:
    """word of each run of letters, of which one in `damage` loses a letter, both by a crc32 of id and run; those of `shortest` letters or more."""
    found = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit("([A-Za-z\\u00C0-\\u00FF]+)"), 1))
    run = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), found.alias("run"))
    run = run.filter(F.length("run") >= shortest).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))  # none grows
    h = F.crc32(F.concat_ws(":", "id", "run"))
    run = run.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return run.select(F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)


def parity_mask(word: Column) -> Column:
    """Bits of the letters that the word has an odd number of times."""
    bit = lambda c: F.when(F.ascii(c) < 128, F.instr(F.lit(LETTERS), c) - 1).otherwise(len(LETTERS) + F.ascii(c) % OTHER_BITS)
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int"))))


def band(mask: Column, b: int) -> Column:
    bits = sum(1 << i for i in range(b, len(LETTERS) + OTHER_BITS, BANDS))
    return mask.bitwiseAND(F.lit(bits).cast("long"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n and b_n of every unordered pair of different words (word, n; each once) exactly one edit apart."""
    masked = words.select("word", "n", parity_mask(F.col("word")).alias("mask"), F.length("word").alias("size"))

    def meeting(size: Column, word: Column) -> Column:
        """Every (band, band's value, half, letters of it) by which a word meets those of which the shorter has that size."""
        half = F.floor(size / 2).cast("int")
        first, last = F.substring(word, F.lit(1), half), F.substring(word, -(size - half), size - half)
        ways = [F.struct(F.lit(b).alias("b"), band(F.col("mask"), b).alias("v"), F.lit(side).alias("side"), letters.alias("letters")) for b in range(BANDS) for side, letters in ((0, first), (1, last))]
        return F.array(*ways)

    short = masked.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), F.col("size"), F.inline(meeting(F.col("size"), F.col("word"))))
    either = masked.withColumn("short", F.explode(F.array("size", F.col("size") - 1)))
    long = either.select(F.col("word").alias("b_word"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), F.col("size").alias("b_size"), F.col("short").alias("size"), F.inline(meeting(F.col("short"), F.col("word"))))
    differ = lambda b: band(F.col("a_mask"), b) != band(F.col("b_mask"), b)
    first_band = (F.col("s.b") == 0) | ((F.col("s.b") == 1) & differ(0)) | ((F.col("s.b") == 2) & differ(0) & differ(1))
    half = F.floor(F.col("s.size") / 2).cast("int")
    first_half = (F.col("s.side") == 0) | (F.substring("a", F.lit(1), half) != F.substring("b_word", F.lit(1), half))
    once = (F.col("b_size") > F.col("s.size")) | (F.col("a") < F.col("b_word"))
    flips = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2
    equal = [F.col(f"s.{k}") == F.col(f"l.{k}") for k in ("b", "v", "side", "letters", "size")]
    met = equal[0]
    for c in (*equal[1:], once, flips, first_band, first_half, F.levenshtein("a", "b_word", 1) == 1):
        met = met & c
    return short.alias("s").hint("merge").join(long.alias("l"), met).select("a", F.col("b_word").alias("b"), "a_n", "b_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, damage: int = 199, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of `shortest` letters that occurs `least` times or more."""
    words = saved(runs(docs, doc_id, text, shortest, damage).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "words")
    pairs = saved(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = words.hint("merge").join(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "word", "left")
    found = F.col("best.near_n") >= ratio * F.col("n")
    table = saved(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("best.near")).alias("form"), F.when(found, F.col("best.near_n")).alias("form_n")), "forms")
    largest = table.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(largest, ratio))) if ratio > 1 else largest.bit_length() * 64
    roots = table.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = saved(roots.hint("merge").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return table.hint("merge").join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
