import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, empty, words
from tracewright.llm import hmm_scoring as hmm
from tracewright.llm.ann import Forest, nearest, op6_ann, shards_of


def tokens(t):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [w.translate(str.maketrans(upper, upper.lower())) for w in words(t)] + [None]


def with_folds(df):
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)


def test_base_scores_equal_direct_counts(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    wanted = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, round(sum(np.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t)), 4)) for i, t in rows)
    for near in (1 << 17, 30):  # with nearly all words joined by shuffle too
        out = hmm.hmm_scores(with_folds(docs), states=3, rounds=1, top_classes=20, tail_classes=16, near_words=near).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == wanted
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert hmm.hmm_scores(with_folds(empty(spark))).count() == 0


def random_model(k=3, c=6, seed=0):
    r = np.random.default_rng(seed)
    return hmm.Hmm(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(c), k))


def test_forward_equals_the_sum_over_all_paths():
    from itertools import product

    m = random_model()
    seqs = [np.array(s) for s in ([1], [0, 5, 2], [3, 3, 1, 4], [2, 2])]
    got = np.zeros(len(seqs))
    for own, packed, reach in hmm.groups_of(seqs, 5):
        got[own] = hmm.forward(m, packed, reach)[2]
    for s, g in zip(seqs, got, strict=True):
        p = sum(m.start[z[0]] * np.prod([m.move[a, b] for a, b in zip(z, z[1:], strict=False)]) * np.prod([m.emit[a, x] for a, x in zip(z, s, strict=True)]) for z in product(range(3), repeat=len(s)))
        assert g == pytest.approx(np.log(p))


def test_likelihoods_of_all_sequences_sum_to_one():
    from itertools import product

    m = random_model()
    seqs = [np.array(s) for s in product(range(6), repeat=3)]
    assert sum(np.exp(hmm.forward(m, p, r)[2]).sum() for _, p, r in hmm.groups_of(seqs)) == pytest.approx(1)


def test_baum_welch_counts_add_up_and_raise_the_likelihood():
    r = np.random.default_rng(1)
    seqs = [r.integers(0, 6, r.integers(1, 30)) for _ in range(40)]
    m = random_model()
    last = -np.inf
    for _ in range(5):
        total = [0.0, 0.0, 0.0, 0.0]
        for _, p, reach in hmm.groups_of(seqs, 100):
            total = [a + b for a, b in zip(total, hmm.expected_counts(m, p, reach), strict=True)]
        start, move, emit, log = total
        assert start.sum() == pytest.approx(40) and emit.sum() == pytest.approx(sum(map(len, seqs))) and move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs))
        assert log > last - 1e-9
        last, m = log, hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def test_scores_equal_a_sum_over_all_paths_end_to_end(spark):
    from itertools import product

    import pyarrow as pa

    states, rounds, top, tails, smooth = 2, 2, 3, 4, 5.0
    texts = ["a b a c", "b b a", "", None, "c a d e", "a B zz", "zz zz a b", "d", "new words here", "a c b", "e b"]
    rows = [(i, t, i % 4 == 3) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["score"] for r in hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), states, rounds, top, tails, near_words=4).collect()}

    c = Counter(w for _, t, held in rows if not held for w in tokens(t))
    below = sum(c.values()) + 0.1 * (len(c) + 1)
    vocabulary = sorted({w for _, t, _ in rows for w in tokens(t) if w is not None})
    t = hmm._Lowered(pa.array(vocabulary))
    digest, tail = dict(zip(vocabulary, t.word_hash().view(np.int64).tolist(), strict=True)), dict(zip(vocabulary, hmm._tails(t, tails).tolist(), strict=True))
    first = sorted((w for w in c if w is not None), key=lambda w: (-c[w], digest[w]))[:top]
    class_of = lambda w: top + tails if w is None else first.index(w) if w in first else top + tail[w]
    class_p = np.zeros(top + tails + 1)
    for w, n in c.items():
        class_p[class_of(w)] += (n + 0.1) / below
    class_p[top : top + tails] += 0.1 / below  # a place for unknown words in each tail class
    m = hmm.first_guess(class_p, states, 5)
    paths = lambda s: {z: m.start[z[0]] * np.prod([m.move[a, b] for a, b in zip(z, z[1:], strict=False)]) * np.prod([m.emit[a, x] for a, x in zip(z, s, strict=True)]) for z in product(range(states), repeat=len(s))}
    for _ in range(rounds):
        start, move, emit = np.ones(states), np.ones((states, states)), smooth * states * np.stack([class_p] * states)
        for _, text, held in rows:
            if not held:
                s = [class_of(w) for w in tokens(text)]
                p = paths(s)
                for z, x in p.items():
                    share = x / sum(p.values())
                    start[z[0]] += share
                    for a, b in zip(z, z[1:], strict=False):
                        move[a, b] += share
                    for a, k in zip(z, s, strict=True):
                        emit[a, k] += share
        m = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    for i, text, _ in rows:
        s = [class_of(w) for w in tokens(text)]
        shares = sum(np.log10((c[w] + 0.1) / below / class_p[class_of(w)]) for w in tokens(text))
        assert found[i] == pytest.approx(np.log10(sum(paths(s).values())) + shares, abs=1e-6)


def test_long_sequences_are_scaled_at_any_step():
    m, r = random_model(4, 50, 3), np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 8, 9, 700):
        s = r.integers(0, 50, n)
        a, log = m.start * m.emit[:, s[0]], 0.0
        for x in s[1:]:
            log += np.log(a.sum())
            a = a / a.sum() @ m.move * m.emit[:, x]
        ((_, packed, reach),) = hmm.groups_of([s])
        assert hmm.forward(m, packed, reach)[2][0] == pytest.approx(log + np.log(a.sum()))


def test_beats_the_base_on_held_out_texts(spark):
    out = hmm.op5_hmm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1] + 0.05 * abs(out[1])


def brute(rows, ids, k):
    out = {}
    for q in ids:
        v = next(np.array(x) for i, x in rows if i == q)
        near = sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = near[:k]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = op6_ann(spark, "/root/testdata/sf0.1").collect()
    true = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    distance = {(q, i): d for q, near in true.items() for d, i in near}
    hits = [(r["query_id"], r["vec_id"]) in distance for r in found]
    assert len(found) == 10 * len(true) and np.mean(hits) >= 0.9
    assert all(r["score"] == pytest.approx(distance[r["query_id"], r["vec_id"]], abs=1e-12) for r, h in zip(found, hits, strict=True) if h)


def test_awkward_vectors(spark):
    good = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    bad = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (400, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]), (600, [1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    out = nearest(df, df.filter("vec_id % 100 = 0"), k=10, target_recall=1.0, widest_shard=8).collect()
    assert {r["query_id"] for r in out} == {0}
    true = brute(good, [0], 10)[0]
    assert [(r["score"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == true
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert nearest(few, few.filter("vec_id = 0")).count() == 2


def test_each_length_is_searched_by_itself(spark):
    long, short = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], [(1000 + i, [float(i % 7), 1.0 + i % 4]) for i in range(20)]
    df = spark.createDataFrame(long + short, "vec_id long, embedding array<double>")
    out = nearest(df, df.filter("vec_id % 10 = 0"), k=10, target_recall=1.0, widest_shard=8).collect()
    for rows in (long, short):
        for q, true in brute(rows, [i for i, _ in rows if i % 10 == 0], 10).items():
            assert [(r["score"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == true
    assert len(out) == 60


def test_repeated_queries_are_one_and_ties_go_to_the_smaller_id_across_shards(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([rows[0], rows[0], rows[5]], df.schema)
    out = nearest(df, queries, target_recall=1.0, widest_shard=9).collect()
    for q, true in brute(rows, [0, 5], 10).items():
        assert [(r["score"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == true
    assert len(out) == 20 and shards_of(31, 9) == 4


def test_few_rows_are_measured_among_clusters():
    r = np.random.default_rng(0)
    middle = r.normal(size=(200, 32))
    x = middle[r.integers(0, 200, 20_000)] + 0.05 * r.normal(size=(20_000, 32))
    forest, ids = Forest(x, x.mean(axis=0), 64, 24, 6), np.arange(len(x))
    hits = measured = 0
    for i, (best, far, n) in enumerate(forest.nearest(x[:100], [np.array([i]) for i in range(100)], ids, 10, 0.95)):
        true = np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[1:11]
        hits += len(set(best) & set(true))
        measured += n
        assert (np.diff(far) >= 0).all()
    assert hits >= 900 and measured < 0.05 * 100 * len(x)
