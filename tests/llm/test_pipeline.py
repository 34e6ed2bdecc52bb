from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_jaccard import truth
from tests.llm.texts import documents, empty, words
from tracewright.scratch import saved


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    columns = docs.columns
    kept = saved(cp.keep_quality(spark, docs, ""), "t")
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} >= {100, 101, 102, 103, 205}
    lang = saved(cp.keep_language(spark, kept, ""), "t")
    assert lang.columns == columns and lang.count() == kept.count()
    one = saved(cp.keep_one_of_near_copies(spark, lang, ""), "t")
    ids = [r["doc_id"] for r in one.collect()]
    wanted = {c for _, _, c in truth([(r["doc_id"], r["text"]) for r in lang.collect()])}
    assert one.columns == columns and sorted(map(str, ids)) == sorted(wanted)
    mix = saved(cp.mix_sources(spark, one, ""), "t")
    assert mix.columns == columns and all(r["n_chars"] == len(r["text"]) for r in mix.collect())
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in mix.collect():
        assert set(words(r["text"])) <= set(words(texts[r["doc_id"]]))
    size = lambda df: sum(len(words(r["text"])) for r in df.collect())
    assert abs(size(mix) - size(one)) < 0.1 * size(one)
    packed = cp.pack_sequences(spark, mix, "").collect()
    assert sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(r["length"] for r in packed)


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in cp.STAGES:
        docs = saved(stage(spark, docs, ""), "t")
        assert docs.count() == 0


def test_run_is_the_stages(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(cp.STAGES) == 5


def test_names_of_columns_do_not_matter_to_the_stages(spark):
    names = ["verdict", "k1", "k2", "h1", "h2", "id", "row", "kept_", "_h1", "_taken", "_copies", "mix_", "_words", "_key", "_hot", "_meet", "a.b", "text.x", "a`b"]
    docs = documents(spark).select("*", *(F.lit(7 + i).alias(n) for i, n in enumerate(names)))
    assert cp.pack_sequences(spark, docs, "").count() > 0
    for _, stage in cp.STAGES[:-1]:
        docs = saved(stage(spark, docs, ""), "t")
        assert docs.columns[-len(names) :] == names
        rows = docs.collect()
        assert rows and all(r[n] == 7 + i for r in rows for i, n in enumerate(names))
