import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, empty, words
from tracewright.llm import quality_classifier as qc
from tracewright.llm._text import Texts, slices
from tracewright.llm.quality_rules import judged, quality_rules


def brute(t, least):
    w = words(t)
    n, best = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    covered = {p for i, b in enumerate(best) if b >= least for p in range(i, i + b)}
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = {p for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(covered), max(best, default=0)


def test_statistics_and_repeats_equal_brute_force():
    r = random.Random(3)
    texts = [None, "", "a", " \n ", "a b a b a b", "é ü\né ü\n\né ü x#|"]
    texts += ["".join(r.choice(["a ", "b ", "é ", "c\n", "\n", "#"]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    for t, found in zip(texts, judged(pa.array(texts), 3, 0.3, 5).to_pylist(), strict=True):
        assert tuple(found[n] for n in names) == brute(t, 3), t
        assert sum(s["words"] for s in found["spans"]) == found["covered_words"]


def test_slices_and_texts_do_not_depend_on_batching():
    texts = [None, "", "x y", "é" * 50, "a b c"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]).slice(3)
    parts = [Texts(s.column("t")).word_hash().tolist() for s in slices(batch, "t", 20)]
    assert sum(parts, []) == Texts(batch.column("t")).word_hash().tolist()


def test_awkward_rows(spark):
    docs = documents(spark).withColumn("quality_verdict", F.lit(1))
    out = quality_rules(docs)
    assert out.count() == docs.count() and out.columns == docs.columns
    kept = {r["doc_id"] for r in out.filter("quality_verdict.kept").collect()}
    assert {100, 101, 205} <= kept and not kept & {200, 201, 202, 203}
    assert quality_rules(empty(spark)).count() == 0


def test_repetition_is_rejected_only_by_its_rule():
    phrase = " ".join(f"w{i}" for i in range(7))
    t = " ".join(f"{phrase} u{i}" for i in range(20))
    found = judged(pa.array([t]), 6, 0.3, 200).to_pylist()[0]
    assert found["n_repeat_words"] == 0 and not found["base_failed"] and not found["kept"]


def test_rule_ensemble_learns_and_compiles(spark):
    r = np.random.default_rng(0)
    x = r.random((1500, len(qc.FEATURES)))
    y = ((x[:, 2] > 0.6) | ((x[:, 3] > 0.7) & (x[:, 5] < 0.4))).astype(float)
    model = qc.RuleEnsemble.fitted(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    assert 0 < len(model.rules) < len(qc.grown_rules(x[:1000], y[:1000], 40, 3))
    df = spark.createDataFrame([[float(v) for v in row] for row in x[1000:1100]], list(qc.FEATURES))
    assert np.allclose([v[0] for v in df.select(model.expression()).collect()], model.score(x[1000:1100]))


@pytest.mark.parametrize("y", [[], [1.0] * 60, [0.0, 1.0]])
def test_too_few_labels_give_the_share(y):
    x = np.zeros((len(y), len(qc.FEATURES)))
    assert qc.RuleEnsemble.fitted(x, np.array(y)).score(np.zeros((1, len(qc.FEATURES))))[0] == pytest.approx((sum(y) + 1) / (len(y) + 2))


def test_classifier_on_awkward_rows(spark):
    docs = documents(spark)
    table = qc.with_features(docs)
    assert table.count() == docs.count() and qc.with_features(empty(spark)).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None), (103, 1)], "doc_id long, quality int")
    model = qc.fitted_on(table, labels, "quality", 1000)
    scores = table.select(model.expression().alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scores)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = qc.op9_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert out.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_folds_are_by_crc(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), qc.crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_features_equal_direct_counts():
    import math

    import numpy as np
    import pyarrow as pa

    from tests.llm.texts import rows as awkward
    from tests.llm.texts import words
    from tracewright.llm._text import Texts

    texts = [r[1] for r in awkward()] + ["A b A b\nA b A b\n\n# $5 µé 12 don't. What? (x)", "x " * 3000, "ÀÉ Ж 漢字 42"]
    found = qc.features(Texts(pa.array(texts)))
    assert set(found) == set(qc.FEATURES)
    lines_of = lambda t: [x for x in t.split("\n")]
    for i, t in enumerate(texts):
        t = t or ""
        w, raw = words(t), t.encode()
        chars = sum(map(len, w))
        share = lambda a, b: a / b if b else 0.0
        seen, dup = set(), 0
        for line in lines_of(t):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        windows = {}
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), []).append(k)
        inside = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
        upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 for b in raw)
        wanted = {
            "log_words": math.log1p(len(w)), "mean_word": share(chars, len(w)), "symbols": share(sum(c in "#*$%&|<>" for c in t), len(w)), "uppercase": share(upper, upper + lower),
            "digits": share(sum(48 <= b < 58 for b in raw), chars), "wide": share(sum(b >= 0xC0 for b in raw), chars), "dup_lines": share(dup, t.count("\n") + 1), "repeats": share(len(inside), len(w)),
            "distinct": share(len(set(w)), len(w)), "words_a_line": share(len(w), t.count("\n") + 1),
        }
        for name, value in wanted.items():
            assert abs(found[name][i] - value) < 1e-12, (i, name)
        for name, table in qc._CLASS.items():
            assert abs(found[name][i] - share(sum(int(table[b]) for b in raw), len(w))) < 1e-12, (i, name)
    assert all(np.isfinite(v).all() for v in found.values())
