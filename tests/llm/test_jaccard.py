import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, empty, words
from tracewright.llm._components import components
from tracewright.llm.jaccard_join import jaccard_join, linked, near_pairs, prefix_depth, sorted_forest, telling, wanted_depths, wanted_edges


def truth(rows):
    """Links of each row and the smallest id of its component, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    first = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[i][0]), links[i], str(first[find(i)])) for i in range(len(rows)))


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in jaccard_join(docs, **options).collect())
    assert found == truth(rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert jaccard_join(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_a_large_group_of_near_copies(spark, block):
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 5])):
            t[r.randrange(150)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(20)]
    check(spark, rows, block_classes=block)


def test_exact_at_the_threshold():
    a = np.arange(90, dtype=np.uint64)
    b = np.concatenate([a[:80], np.arange(1000, 1010, dtype=np.uint64)])
    assert linked([a, b], 0.8)[0, 1]  # 80 of 100
    assert not linked([a, b[:-1].copy(), b[1:].copy()], 0.8)[0, 2]
    assert not linked([a, b], 0.8, np.array([0, 0])).any()


def test_prefixes_are_shortened_to_the_target():
    assert prefix_depth(0.8, 24, 8, 0.995) == 7
    assert prefix_depth(0.8, 24, 8, 0.5) == 8
    assert prefix_depth(0.8, 1, 8, 0.99) == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[101] == 100 and len(out) == 63


def test_pairs_across_equal_those_within():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 50)).astype(np.uint64) for _ in range(30)]
    whole = linked(sets, 0.5)
    jaccard = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (whole == ((jaccard >= 0.5) & ~np.eye(30, dtype=bool))).all() and whole.any()
    assert (near_pairs(sets[:11], sets[11:], 0.5) == whole[:11, 11:]).all()


def test_neighbours_in_the_sorted_labels(spark):
    r = np.random.default_rng(3)
    labels = r.integers(0, 3, (200, 2, 4)).astype(">u2")  # two trees of four values
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(labels)], "c long, labels binary").repartition(3)
    found = sorted_forest(classes, 2, 4, 2).collect()
    seen = set()
    for t in range(2):
        order = sorted(range(200), key=lambda i: (labels[i, t].tolist(), i))
        for a, c in zip(order, order[1:], strict=False):
            shared = int(np.cumprod(labels[a, t] == labels[c, t]).sum())
            if shared >= 2:
                seen.add((a, c, shared))
    assert {(x["a"], x["c"], x["shared"]) for x in found} == seen and len(found) >= len(seen)
    for x in found:
        t, c = x["tree"], x["c"]
        for shared, head in zip((2, 3, 4), x["heads"], strict=True):  # rows between the head and c share as much
            assert labels[head, t, :shared].tolist() == labels[c, t, :shared].tolist() if shared <= x["shared"] else head == c
    for t in range(2):
        alike = {}
        for i in range(200):
            alike.setdefault(tuple(labels[i, t, :2]), set()).add(i)
        ranges = {}
        for x in found:
            if x["tree"] == t:
                ranges.setdefault(x["range"], set()).update((x["a"], x["c"]))
        assert sorted(map(sorted, ranges.values())) == sorted(sorted(g) for g in alike.values() if len(g) > 1)


@pytest.mark.parametrize("tasks", [1, 5])
def test_a_range_hangs_together_down_to_the_depth_that_one_of_it_wants(spark, tasks):
    """Three clusters and a single row share 7 of 10 values: rows want 10, one in the middle wants 7, so the pairs across clusters are candidates."""
    rows = [[1] * 7 + [k] * 3 for k in (1, 1, 2, 2, 3, 4, 4)] + [[2] * 7 + [k] * 3 for k in (1, 1, 2, 2)]
    labels = [bytearray(np.array(x, ">u2").tobytes()) for x in rows]
    classes = spark.createDataFrame(list(enumerate(labels)), "c long, labels binary").repartition(3)
    depths = spark.createDataFrame([(i, 7 if i == 4 else 10) for i in range(len(rows))], "c long, depth int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        near = sorted_forest(classes, 1, 10, 7)
        groups = {}
        for r in components(wanted_edges(near, depths, 7)).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4, 5, 6], [7, 8], [9, 10]]


@pytest.mark.parametrize("size", [100, 1000])
def test_links_do_not_depend_on_the_size_of_their_group(spark, size):
    """A chain of texts of which only neighbours are alike, with the same texts at its start: compared whole in blocks, or shingle by shingle."""
    tokens = [f"w{i}" for i in range(4 * size + 120)]
    rows = [(i, " ".join(tokens[4 * i : 4 * i + 100])) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join(docs, block_classes=128, target_recall=0.99999).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for _, t in rows[:60]]
    for i in range(40):
        links = sum(9 * len(sets[i] & s) >= 4 * (len(sets[i]) + len(s)) for s in sets) - 1
        assert found[i] == (links, 0)


def test_shingles_that_tell():
    for size in range(1, 60):
        for t in (0.5, 0.8, 0.95):
            a = np.arange(size)
            for other in range(1, size + 1):  # the worst pair: what they share are their largest
                shared = math.ceil(t * (size + other) / (1 + t) - 1e-9)
                if shared <= other:
                    assert size - shared < telling(size, t) and other - shared < telling(other, t), (a, other)


def test_prefixes_stay_long_where_matches_are_close(spark):
    rows = [(1, 2)] * 24 + [(3, 4)] * 3 + [(5, 6)] * 24 + [(6, 7)] * 2
    out = {x["c"]: x["depth"] for x in wanted_depths(spark.createDataFrame(rows, "a long, c long"), 24, 10, 7, 0.8, 0.995).collect()}
    assert out == {1: 10, 2: 10, 3: 7, 4: 7, 5: 10, 6: 7, 7: 7}


def test_a_chain_of_small_nodes_is_compared_node_by_node(spark):
    words_ = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words_[6 * i : 6 * i + 100])) for i in range(95)]  # each like the next few only
    rows += [(200 + i, rows[i][1]) for i in range(3)]
    check(spark, rows, block_classes=8, target_recall=0.9999)


def test_recall_of_links_on_whole_documents(spark):
    """Queries: ids divisible by 50, against all rows of sf0.1."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/documents.parquet"
    texts = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    sets = {}
    for i, t in zip(texts["doc_id"], texts["text"], strict=True):
        w = words(t)
        sets[i] = {hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)} if len(w) >= 5 else {hash(tuple(w))} if w else set()
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    out = {r["doc_id"]: r for r in jaccard_join(spark.read.parquet(path)).filter(F.lit(True)).collect()}
    links = found = 0
    for q in (i for i in sets if i % 50 == 0):
        common = {}
        for x in sets[q]:
            for j in holders[x]:
                common[j] = common.get(j, 0) + 1
        near = [j for j, k in common.items() if j != q and 9 * k >= 4 * (len(sets[q]) + len(sets[j]))]
        links += len(near)
        found += min(len(near), out[q]["n_links"])
        assert out[q]["n_links"] <= len(near)
        assert all(out[j]["class_id"] <= min(j, q) for j in near) or out[q]["n_links"] < len(near)
    assert links and found >= 0.99 * links
