import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, empty
from tracewright.llm.spelling import near_pairs, op11_spelling, parity_mask, spelling_variants


def words_of(rows, shortest=6, least=5, damage=199):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(n, ratio=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def collected(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute(words_of(docs))
    assert len(want) > 500 and sum(v[1] > 0 for v in want.values()) > 20
    assert collected(op11_spelling(spark, "/root/testdata/sf0.001")) == want


def test_chains_ties_and_awkward_rows(spark):
    many = {"letters": 2000, "lettersé": 300, "letteréé": 40, "latteréé": 5, "lettres": 300, "lxtters": 6, "lytters": 6, "Abcdef": 50, "abcdeg": 50, "abcdex": 6, "short": 50, "×÷×÷×÷": 5}
    rows = [(i % 7, " ".join([w] * n)) for i, (w, n) in enumerate(many.items())]
    rows += [(None, "letters; letters"), (8, None), (9, ""), (10, "...\n\t"), (11, "a" * 3_000_000), (11, "abcdex"), (11, "abcdex")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` string").repartition(3)
    for damage in (199, 3):
        got = collected(spelling_variants(docs, damage=damage))
        assert got == brute(words_of(rows, damage=damage))
    chained = collected(spelling_variants(docs, damage=1 << 40))
    assert chained["latteréé"][4] == "letters" and chained["abcdex"][2] == "abcdef"  # a tie goes to the first by code points


def test_empty_and_shared_fixture(spark):
    assert spelling_variants(empty(spark)).count() == 0
    docs = documents(spark)
    assert collected(spelling_variants(docs, least=2)) == brute(words_of([(r["doc_id"], r["text"]) for r in docs.collect()], least=2))


def test_pairs_of_random_words_come_once(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abcé") for _ in range(r.choice([6, 7, 8]))) for _ in range(600)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [frozenset((x["a"], x["b"])) for x in near_pairs(table).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(want) > 150 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("word", ["aabbc", "été", "zzz", ""])
def test_mask_holds_letters_of_odd_counts(spark, word):
    mask = spark.range(1).select(parity_mask(F.lit(word))).first()[0]
    assert bin(mask).count("1") == sum(n % 2 for n in Counter(word).values())


def test_joins_are_never_broadcast(spark):
    words = spark.createDataFrame([("winter", 9), ("winters", 5)], "word string, n long")
    docs = spark.createDataFrame([(i, "winter winters") for i in range(9)], "doc_id long, text string")
    for df in (near_pairs(words), spelling_variants(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
