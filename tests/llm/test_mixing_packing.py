import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, empty, words
from tracewright.llm.mixing import capped_targets, even_quota, mixed, mixed_texts, sainte_lague, times_taken
from tracewright.llm.packing import combinations, nonnegative_counts, pack, packed


def by_quotients(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(m for m, v in zip(most, votes, strict=True) if v))):
        free = [i for i in range(len(votes)) if got[i] < most[i] and votes[i]]
        got[max(free, key=lambda i: (Fraction(votes[i]) / (2 * got[i] + 1), -i))] += 1
    return got


def test_seats_by_highest_quotients():
    r = np.random.default_rng(0)
    for _ in range(60):
        votes, most = r.integers(0, 40, 6).tolist(), r.integers(0, 12, 6).tolist()
        seats = int(r.integers(0, 40))
        got = sainte_lague(np.array(votes), seats, np.array(most))
        wanted = by_quotients(votes, seats, most)
        assert got.sum() == sum(wanted) and (got == wanted).all()


def test_a_shards_quota_is_that_of_the_whole_list():
    r = np.random.default_rng(2)
    for _ in range(300):
        size = int(r.integers(1, 9))
        blocks, quota = int(r.integers(1, 60)), int(r.integers(0, 170))
        full = [min(size, blocks - at) for at in range(0, blocks, size)]
        quota = min(quota, 3 * blocks)
        wanted = by_quotients(full, quota % blocks, full)
        assert [even_quota(blocks, quota, k, size) for k in range(len(full))] == [quota // blocks * n + w for n, w in zip(full, wanted, strict=True)]


def test_a_source_of_ten_billion_blocks_takes_no_list():
    import time

    began, cache = time.perf_counter(), {}
    size = 32 * 10**10 - 5
    for k in range(200):
        first = k * 49_999_999
        taken = times_taken(size, 7 * 10**9 + 3, 0, first, first + 2000, 32, 1024, 20, cache)
        assert len(taken) == 2001 and set(taken) <= {0, 1} and 0.6 < taken.mean() < 0.8
    assert time.perf_counter() - began < 1


def test_targets_stop_at_three_times_the_size():
    t = capped_targets([100, 10, 10], [1, 2, 3], 3)
    assert t == [pytest.approx(60), 30, 30] and capped_targets([0, 0], [1, 2], 3) == [0, 0]


def test_mix_of_awkward_rows(spark):
    docs = documents(spark).withColumn("mix", F.lit(0))
    first, again = (mixed(docs).select(*docs.columns).collect() for _ in range(2))
    rows = [(r["doc_id"], r["text"], r["source"], r["mix"]) for r in first]
    assert len(rows) == docs.count()
    assert sorted(map(str, rows)) == sorted(str((r["doc_id"], r["text"], r["source"], r["mix"])) for r in again)
    taken, target = {}, {}
    for _, t, s, m in rows:
        assert m["size"] == len(words(t)) and 0 <= m["taken"] <= 3 * m["size"]
        assert m["taken"] == sum(x["words"] for x in m["runs"])
        taken[s] = taken.get(s, 0) + m["taken"]
        target[s] = m["target"]
    assert all(abs(taken[s] - target[s]) <= 100 for s in target)
    order = sorted((s for s in target if s is not None)) + [None]
    sizes = [sum(len(words(t)) for _, t, s, _ in rows if s == x) for x in order]
    assert [target[x] for x in order] == capped_targets(sizes, [1 + i % 3 for i in range(len(order))], 3)
    assert mixed(empty(spark)).count() == 0


def test_packing_of_lengths():
    r = np.random.default_rng(1)
    for lengths in ([], [1], [1024], [1023, 1], [5000] * 3, r.integers(1, 3000, 700), [700] * 50):
        lengths = np.array(lengths, np.int64)
        pieces, n = pack(lengths)
        doc, start, size, seq, offset = pieces
        seen = {}
        for d, s, k in sorted(zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)):
            assert s == seen.get(d, 0) and k > 0
            seen[d] = s + k
        assert seen == {i: k for i, k in enumerate(lengths.tolist())}
        fill = np.zeros(n, int)
        for i in np.lexsort((offset, seq)):
            assert offset[i] == fill[seq[i]]
            fill[seq[i]] += size[i]
        assert (fill[:-1] == 1024).all() and (not n or 0 < fill[-1] <= 1024)


def test_combinations_fill_the_window_and_fit_the_histogram():
    counts = np.zeros(1025)
    counts[[300, 724, 200, 624]] = [10, 10, 7, 0]
    c = combinations(counts, 1024, 64)
    assert (c.sum(axis=1) == 1024).all() and [300, 724, 0] in c.tolist()
    x = nonnegative_counts(c, counts[:1024])
    assert (x >= 0).all() and x[c.tolist().index([300, 724, 0])] == pytest.approx(10, rel=0.05)


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark).unionByName(spark.createDataFrame([(900, "it's <|endoftext|>  \n\n x²Ⅷ don't stop　", None, None, 0, "")], documents(spark).schema))
    docs = docs.filter("doc_id IS NOT NULL AND doc_id <> 103")
    pieces = {}
    for r in packed(docs, lot_tokens=5000).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids = code.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces.pop(d["doc_id"]), key=lambda r: r["start"])
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u4")] == ids
        assert all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) // 4 for r in own)
    assert not pieces and packed(empty(spark)).count() == 0


def test_padding_is_one_sequence_a_task(spark):
    docs = documents(spark).coalesce(1)
    fills = packed(docs, lot_tokens=3000).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] for r in fills) and sum(r["n"] < 1024 for r in fills) <= 1


def test_checksums(spark):
    r = packed(documents(spark)).withColumn("c", F.crc32("ids")).first()
    assert r["c"] == zlib.crc32(r["ids"])


def test_names_of_columns_do_not_matter_to_the_mix(spark):
    names = ["id", "row", "size", "stream", "doc", "content", "shard", "_size", "_stream", "_before", "place", "runs", "c0", "words"]
    docs = documents(spark).select("*", *(F.lit(99 + i).alias(n) for i, n in enumerate(names)))
    out = mixed(docs)
    assert out.columns == [*docs.columns, "mix"] and out.count() == docs.count()
    assert all(r[n] == 99 + i for r in out.collect() for i, n in enumerate(names))
    texts = mixed_texts(docs)
    assert texts.columns == docs.columns and all(r[n] == 99 + i for r in texts.collect() for i, n in enumerate(names))


def test_texts_of_the_mix_are_its_runs(spark):
    docs = documents(spark)
    wanted = []
    for r in mixed(docs).collect():
        t = r["text"] or ""
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        copies = {}
        for x in r["mix"]["runs"]:
            whole = x["words"] == len(spans)
            copies.setdefault(x["copy"], []).append(t if whole else t[spans[x["first"]][0] : spans[x["first"] + x["words"] - 1][1]])
        wanted += [(r["doc_id"], "\n".join(c)) for c in copies.values()]
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["text"])) for r in mixed_texts(docs).collect())
    assert mixed_texts(empty(spark)).count() == 0


def test_too_many_sources_raise(spark):
    with pytest.raises(ValueError):
        mixed(documents(spark), most_sources=2)
