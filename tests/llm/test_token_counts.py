import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.texts import documents, empty
from tracewright.llm import token_counts as tc

V = tc.vocabulary_of("byte_bpe_50k.json")
REAL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def wanted(texts):
    return [len(REAL.encode(t, add_special_tokens=False)) for t in texts]


def by_pieces(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    p = tc.Pieces(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64), V)
    raw = data.tobytes()
    n = np.array([1 if a else tc.missed([raw[b:e]], "byte_bpe_50k.json", 1000)[0] for b, e, a in zip(p.begin, p.end, p.added, strict=True)], np.int64)
    return p.per_text(n, p.of_text).tolist()


PARTS = ["'s", "'re", "'ll", "'v", "'", "''", " ", "  ", "\n", "\t ", " ", "　", "a", "re", "S", "12", "٣", "!?", "中", "\U0001f600", "՘", "<|endoftext|>", "<|endoftext", "|>", " ", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=8).map("".join), min_size=1, max_size=5))
def test_pieces_count_as_the_library_does(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert by_pieces(texts) == wanted(texts)


def test_every_code_point_is_classed_as_the_library_does():
    r = random.Random(5)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{s}{chr(c)}b " for c in r.sample(points, 300) for s in ("a", "1", "!", " ", "'")) for _ in range(20)]
    assert by_pieces(texts) == wanted(texts)


def test_query_equals_the_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in tc.op13_token_counts(spark, "/root/testdata/sf0.01").collect()}
    for r, n in zip(rows, wanted([r["text"] for r in rows]), strict=True):
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == (n, len(r["text"].encode()), n > 512)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_awkward_rows(spark, vocabulary):
    docs = documents(spark).withColumnRenamed("kept", "a.b").cache()
    count = tc.library(vocabulary)
    got = sorted(tuple(r) for r in tc.token_counts(docs, vocabulary=vocabulary, limit=20).collect() if r["doc_id"] is not None)
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), count([r["text"] or ""])[0]) for r in docs.collect() if r["doc_id"] is not None)
    assert [g[:3] for g in got] == want and all(g[3] == (g[2] > 20) for g in got)
    assert tc.token_counts(empty(spark), vocabulary=vocabulary).count() == 0


def test_very_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(tc, "PART", 1000)
    r = random.Random(6)
    text = "".join(r.choice(["word", " ", " ", "\n", "'s", "été", "  ", "1", "<|endoftext|>", " "]) for _ in range(30_000))
    taken = list(tc.parts(pa.array([text], pa.large_string())))
    assert len(taken) > 20 and b"".join(d.tobytes() for d, _, _ in taken).decode() == text
    assert sum(by_pieces([d.tobytes().decode()])[0] for d, _, _ in taken) == wanted([text])[0]
    solid = "中" * 5000
    assert len(list(tc.parts(pa.array([solid], pa.large_string())))) == 1 and by_pieces([solid]) == wanted([solid])


def test_summaries_merge_and_any_table_gives_the_same_counts(spark):
    docs = documents(spark).repartition(9)
    v = spark.sparkContext.broadcast(V)
    rows = docs.select("doc_id", "text").fillna("", "text")
    assert tc.frequent_pieces(rows, v, 1 << 14, fan_in=2) == tc.frequent_pieces(rows, v, 1 << 14)
    few = sorted(map(tuple, tc.token_counts(docs.filter("doc_id IS NOT NULL"), table_entries=3, cache_entries=5).collect()))
    assert few == sorted(map(tuple, tc.token_counts(docs.filter("doc_id IS NOT NULL")).collect()))


def test_summary_keeps_what_is_common():
    pieces, counts = [], np.zeros(0, np.int64)
    r = random.Random(7)
    stream = [b"the"] * 300 + [f"w{i}".encode() for i in range(1000)]
    r.shuffle(stream)
    for i in range(0, len(stream), 100):
        part = stream[i : i + 100]
        pieces, counts = tc.commonest(pieces + part, np.concatenate([counts, np.ones(len(part), np.int64)]), 10)
    assert pieces[0] == b"the" and 300 - len(stream) / 11 <= counts[0] <= 300


def test_bytes_that_are_not_utf8():
    column = pa.array([b"ab\xffcd", "é".encode()], pa.large_binary()).view(pa.large_string()) if hasattr(pa.Array, "view") else None
    (data, at, _), = list(tc.parts(column))
    assert data.tobytes().decode() == "ab�cdé" and at.tolist() == [0, 7, 9]
