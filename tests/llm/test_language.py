import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, empty
from tracewright.llm.language_id import ending_counts, language_id, op10_language_id, op10_language_id_pages


def test_agrees_with_declared_languages(spark):
    sf = "/root/testdata/sf0.01"
    met = op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert met.count() == 1000
    assert met.select(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.98
    assert op10_language_id_pages(spark, sf).filter("kept").count() > 240


def test_text_overrules_a_wrong_declaration_and_priors_fill_in(spark):
    # one language's documents mostly on host a, the other's on host b
    rows = [(i, "und der die das nicht " * 8, "de", "a.de") for i in range(30)] + [(100 + i, "the and of with from " * 8, "en", "b.com") for i in range(30)]
    rows += [(200, "und der die das nicht " * 8, "en", "a.de"), (201, "zzzz", None, "b.com"), (202, "zzzz", None, "c.de"), (203, "zzzz", None, "a.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert out[200]["language"] == "de" and out[201]["language"] == "en" and out[203]["language"] == "de"
    assert out[202]["language"] == "de", "a new host follows its address suffix"
    assert out[203]["posterior"] > out[202]["posterior"]


def test_awkward_rows(spark):
    docs = documents(spark)
    out = language_id(docs)
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns) - {"text"} | {"language", "posterior", "kept"}
    by = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert by[200] is False and by[201] is False and by[202] is False and by[205] is True
    assert language_id(empty(spark)).count() == 0


def test_without_declarations_nothing_is_known(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language_id(docs).filter("kept").count() == 0


def test_no_language_is_dropped_by_rank(spark):
    """A hundred languages, the later ones rarer: each keeps its text, declaration, host and suffix evidence."""
    text = lambda k: f"w{k:03d} x{k:03d} y{k:03d} " * 6
    rows = [(100 * k + i, text(k), f"l{k:03d}", f"h{k}.t{k}") for k in range(100) for i in range(2 + (k < 50))]
    rows += [(20_000 + k, text(k), None, None) for k in range(100)] + [(30_000 + k, "zzzz", None, f"h{k}.t{k}") for k in range(100)] + [(40_000 + k, "zzzz", f"l{k:03d}", None) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in language_id(docs).collect()}
    for k in range(100):
        ids = [*(100 * k + i for i in range(2 + (k < 50))), 20_000 + k, 30_000 + k, 40_000 + k]
        assert {out[i]["language"] for i in ids} == {f"l{k:03d}"}
        assert all(out[i]["kept"] for i in ids[:-2])


def test_cells_add_up_in_small_lots(spark):
    docs = documents(spark).selectExpr("text AS _text", "lang AS _lang")
    whole, lots = (ending_counts(docs, ["en", "de", "fr"], 1 << 10, most) for most in (1 << 20, 50))
    assert all((a == b).all() for a, b in zip(whole, lots, strict=True)) and (np.diff(whole[0]) > 0).all()


def test_posteriors_equal_bayes_rule_by_hand(spark):
    import math
    from collections import Counter

    import pyarrow as pa

    from tests.llm.texts import words
    from tracewright.llm._text import Texts
    from tracewright.llm.language_id import _buckets_of

    buckets, strength, reliability = 64, 20.0, 0.9
    rows = [(i, ["der die das", "the and of", "un que el"][i % 3] * (1 + i % 2) + f" w{i % 4}", [None, "de", "en", "es", "en"][i % 5], ["a.de", "b.de", "c.com:80", None, "u@d.com"][i % 5 if i % 7 else 0]) for i in range(40)]
    rows += [(100, "", "de", "a.de"), (101, None, None, None), (102, "the", "de", "10.0.0.1:8080")]
    got = {r["doc_id"]: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), buckets=buckets).collect()}
    said = Counter(lang for *_, lang, _ in rows if lang is not None)
    languages = sorted(said, key=lambda x: (-said[x], x))
    bucket_of = lambda w: int(_buckets_of(Texts(pa.array([w])), buckets)[0])
    endings = Counter((lang, bucket_of(w)) for _, t, lang, _ in rows if lang is not None for w in words(t))
    total = {x: sum(n for (lang, _), n in endings.items() if lang == x) + 0.5 * buckets for x in languages}
    suffix = lambda h: {"a.de": "de", "b.de": "de", "c.com:80": "com", "u@d.com": "com"}.get(h, "")
    for i, t, lang, host in rows:
        own = lambda x: int(x == lang)  # noqa: B023, E731
        like_host, like_suffix = [r for r in rows if r[3] == host and r[2] is not None], [r for r in rows if suffix(r[3]) == suffix(host) and r[2] is not None]
        less = int(lang is not None)
        logs = []
        for x in languages:
            base = said[x] / sum(said.values())
            by_suffix = (sum(r[2] == x for r in like_suffix) - own(x) + strength * base) / (len(like_suffix) - less + strength)
            by_host = (sum(r[2] == x for r in like_host) - own(x) + strength * by_suffix) / (len(like_host) - less + strength)
            declared = 0.0 if lang is None else math.log10(reliability if x == lang else (1 - reliability) / (len(languages) - 1))
            mine = Counter(bucket_of(w) for w in words(t)) if x == lang else Counter()
            text_log = sum(math.log10((endings[x, bucket_of(w)] - mine[bucket_of(w)] + 0.5) / (total[x] - sum(mine.values()))) for w in words(t))
            logs.append(text_log + declared + math.log10(by_host))
        posterior = [10 ** (v - max(logs)) for v in logs]
        best = languages[logs.index(max(logs))]
        assert got[i]["language"] == best or max(posterior[languages.index(got[i]["language"])] for _ in [0]) > 1 - 1e-9
        assert abs(got[i]["posterior"] - 1 / sum(posterior)) < 1e-9
        assert got[i]["kept"] == (bool(words(t)) and 1 / sum(posterior) >= 0.6)


def test_ties_and_names_of_columns(spark):
    names = ["_words", "_likelihood", "_own", "_suffix", "_key", "_spread", "_hot", "_meet", "_evidence", "_best", "_text", "_declared", "c0", "c1", "_of_host", "_rows"]
    docs = documents(spark).select("*", *(F.lit(5 + i).alias(n) for i, n in enumerate(names)))
    out = language_id(docs)
    assert set(out.columns) == set(docs.columns) - {"text"} | {"language", "posterior", "kept"}
    assert all(r[n] == 5 + i for r in out.collect() for i, n in enumerate(names))
    tied = spark.createDataFrame([(1, "x", "b", "h"), (2, "x", "a", "h"), (3, "y", None, "h")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["language"] for r in language_id(tied).collect()}[3] == "a"  # equally often declared: by name


def test_a_wrong_declaration_does_not_vote_for_itself(spark):
    rows = [(i, "und der die das nicht " * 4, "de", "h") for i in range(20)] + [(100 + i, "the and of with from " * 4, "en", "h") for i in range(20)]
    rows.append((300, "zebra quilt " * 30 + "the and of", "de", "h"))  # its rare endings only occur here
    out = {r["doc_id"]: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[300]["posterior"] < 0.99 or out[300]["language"] == "en"


def test_bounds_raise(spark):
    docs = spark.createDataFrame([(i, "a b", f"l{i}", "h") for i in range(5)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError):
        language_id(docs, most_languages=4)
    with pytest.raises(ValueError):
        ending_counts(docs.selectExpr("text AS _text", "lang AS _lang"), ["l0", "l1"], 16, most_cells=1)
