"""A training corpus from the documents table: quality rules, language, near duplicates, mixture and packing.

Every stage takes (spark, docs, sf_dir) with the columns of documents and returns a DataFrame, which is written as Parquet and read again for
the next. The first four return the columns that they got; the last returns pieces of token sequences with their ids. Empty tables pass
through; rows with null texts have no words and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._names import quoted, unused
from tracewright.llm._skew import never_null
from tracewright.llm.jaccard_join import jaccard_join, text_keys
from tracewright.llm.language_id import language_id
from tracewright.llm.mixing import mixed_texts
from tracewright.llm.packing import packed
from tracewright.llm.quality_rules import quality_rules
from tracewright.scratch import saved, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; their columns unchanged."""
    (verdict,) = unused(docs.columns, "verdict")
    return quality_rules(docs, verdict=verdict).filter(F.col(verdict).getField("kept")).select(*map(quoted, docs.columns))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; each row goes through the operator whole."""
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "text", "lang", "source")
    kept = language_id(rows).filter("kept")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by near copies the one with the smallest id; one row of it, if it repeats."""
    stays = jaccard_join(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h1") == F.col("first_h1")) & (F.col("h2") == F.col("first_h2")))
    keys = ["h1", "h2", "id"]
    stays = stays.select("h1", "h2", never_null(F.col("doc_id")).alias("id")).distinct()
    h1, h2 = text_keys(docs["text"])
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), h1.alias("h1"), h2.alias("h2"), never_null(docs["doc_id"]).alias("id"))
    return rows.join(stays, keys, "left_semi").dropDuplicates(keys).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy of a document that it takes, with the words taken in that copy as its text."""
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packed(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express suffix arrays, min-hashes or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
