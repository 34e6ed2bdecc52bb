import math
from fractions import Fraction

import numpy as np
import pyspark.sql.functions as F
import pytest

from tracewright.llm.whitening import from_residues, op12_whitening, primes_over, whitened

SCHEMA = "vec_id long, embedding array<double>, n string, `a.b` int"


def brute(rows, scale=64.0, offset=1_000_000):
    x = {i: [math.floor(scale * c) + offset for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    centered = [[Fraction(n * v[j] - s[j], n) for j in range(d)] for v in fit]
    covariance = np.array([[float(sum(v[i] * v[j] for v in centered) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)
    return {i: (n, sum((n * v[j] - s[j]) ** 2 for j in range(d)), [float(Fraction(n * v[j] - s[j], n)) for j in range(d)]) for i, v in x.items()}, values[order], vectors[:, order].T, np.trace(covariance)


def held_against(got, rows, components):
    exact, values, vectors, trace = brute(rows)
    assert len(got) == sum(1 for _ in rows) * components
    signs = {}
    for r in got:
        n, deviation, centered = exact[r["vec_id"]]
        k = r["component"] - 1
        want = float(vectors[k] @ centered) / math.sqrt(values[k])
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-7)
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(want) == np.sign(r["whitened"]))
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_fractions(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    held_against(op12_whitening(spark, "/root/testdata/sf0.001").collect(), rows, 16)


def test_awkward_rows_are_dropped_and_copies_count_once(spark):
    r = np.random.default_rng(1)
    good = [(i, (r.normal(size=3) * [1, 5, 0.2] + [0, 1e6, 0]).tolist()) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(40)] + [(300, good[3][1])]
    bad = [(None, None), (200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [1.0, float("inf"), 2.0]), (204, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], SCHEMA).repartition(4)
    held_against(whitened(table).collect(), good, 3)
    assert whitened(table.union(table.filter("vec_id = 300"))).filter("vec_id = 300").count() == 6  # a repeated row
    assert whitened(table.limit(0)).count() == 0


def test_directions_without_variance_and_other_lengths(spark):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in [(0, [0.0, 1.0, 1.0]), (1, [1.0, 2.0, 2.0]), (2, [0.0, 5.0, 5.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5])]], SCHEMA)
    rows = {(x["vec_id"], x["component"]): x for x in whitened(table).collect()}
    assert len(rows) == 3 * 3 + 2 * 2
    assert rows[0, 3]["whitened"] is None and rows[0, 2]["whitened"] is not None and rows[0, 1]["identity_error"] < 1e-9
    assert rows[3, 1]["whitened"] is None and rows[3, 1]["explained"] is None and (rows[3, 1]["n"], rows[3, 1]["deviation"]) == (1, 0)
    with pytest.raises(ValueError):
        whitened(table, most_lengths=1)
    with pytest.raises(Exception, match="too large"):
        whitened(spark.createDataFrame([(0, [1e300], "x", 1)], SCHEMA)).count()


def test_sums_beyond_longs_are_exact(spark):
    good = [(i, [float(2**40 * (i % 5)), float(-(2**41)) * (i % 3)]) for i in range(30)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in good], SCHEMA)
    exact = brute(good)[0]
    got = whitened(table).select("vec_id", F.col("deviation").cast("string").alias("deviation")).collect()
    assert all(int(x["deviation"]) == exact[x["vec_id"]][1] for x in got) and max(v[1] for v in exact.values()) > 2**63


def test_residues_give_integers_back():
    primes = primes_over(10**40)
    assert all(p > 2**20 and all(p % q for q in range(2, 1450)) for p in primes)
    for x in (0, 1, -1, 10**39, -(10**39), 123456789**4):
        assert from_residues([x % p for p in primes], primes) == x
