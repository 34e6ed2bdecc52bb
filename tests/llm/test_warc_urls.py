import base64
import hashlib

import pytest

from tests.oracle import assert_same
from tracewright.llm.catalog import ORACLES, QUERIES
from tracewright.llm.url_filters import rarest_index, token_counts, url_filters, whole_tokens
from tracewright.llm.warc import chunked, dechunked, parsed, read_warc, reassembled, with_revisits, write_warc
from tracewright.scratch import new_path


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    for sf in ("sf0.001", "sf0.01"):
        assert_same(QUERIES[name](spark, f"/root/testdata/{sf}"), ORACLES[name], f"/root/testdata/{sf}")


def test_chunked_framing():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n", bytes(range(256)) * 40):
        assert dechunked(chunked(payload, 7)) == payload
    assert dechunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n"):
        assert dechunked(broken) is None


def test_archives_round_trip(spark, tmp_path):
    html = [None, "", "é" * 30_000, "same", "same", "a\r\n\r\nWARC/1.1\r\nb", "same", "", "x" * 16384]
    rows = [(i if i != 6 else 4, f"http://h/{i}" if i % 2 else None, h, "page") for i, h in enumerate(html)] + [(None, "u\r\nx", "only", "page")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").coalesce(2)
    path = str(tmp_path / "w")
    write_warc(with_revisits(pages), path, segment_bytes=1000, chunk_bytes=333)
    found = reassembled(read_warc(spark, path)).collect()
    assert len(found) == len(rows) and all(r["problem"] is None for r in found)
    whole = [r for r in found if r["record_type"] == "response"]
    assert sorted(bytes(r["payload"]) for r in whole) == sorted({(h or "").encode() for _, _, h, _ in rows})
    for r in whole:
        assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["declared_digest"]
    revisits = [r["refers_to"] for r in found if r["record_type"] == "revisit"]
    assert sorted(x.split(":")[2] for x in revisits) == ["4", "4", "7", "7"]


def test_damaged_segments_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    write_warc(with_revisits(pages), str(tmp_path / "w"), segment_bytes=1000)
    records = read_warc(spark, str(tmp_path / "w"))
    bad = reassembled(records.filter("segment <> 3")).first()
    assert bad["payload"] is None and bad["problem"] == "missing or repeated segment"
    last = records.agg({"segment": "max"}).first()[0]
    assert reassembled(records.filter(f"segment <> {last}")).first()["problem"] == "no total length"
    with pytest.raises(ValueError):
        list(parsed(b"junk"))


def test_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(with_revisits(pages), str(tmp_path / "w"))
    assert reassembled(read_warc(spark, str(tmp_path / "w"))).count() == 0
    assert url_filters(pages).count() == 0


def test_rules_are_found_by_their_rarest_token(spark):
    assert whole_tokens("||ads-track.") == ["ads", "track"]
    assert whole_tokens("/porn*video^") == [] and whole_tokens("viagra") == [] and whole_tokens("|http://x.") == ["http", "x"]
    index, rest = rarest_index(["||a.b.", "viagra"], {"a": 5, "b": 2})
    assert index == {"b": ["||a.b."]} and rest == ["viagra"]
    urls = spark.createDataFrame([("http://a.b/a",), ("http://A.c/",), (None,)], "url string")
    assert token_counts(urls, "url", ["||a.b."]) == {"a": 2, "b": 1}


def test_verdicts(spark):
    rows = [
        ("http://x.Example.COM/en/7?q", "x.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://foo.com/en/1", "foo.com", "/en/1", "com/en/", "block"),
        ("https://notexample.net/de/8#x", "notexample.net", "/de/8", "net/de/", "allow"),
        ("https://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://www.ads-track.example.org/fr/1", "www.ads-track.example.org", "/fr/1", None, "block"),
        ("http://myads-track.example.org/fr/1", "myads-track.example.org", "/fr/1", None, "allow"),
        ("http://h.example.org/en/1?viagra", "h.example.org", "/en/1", None, "allow"),
        ("buy-VIAGRA-now", "", "", None, "block"),
        ("http://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(r[0], "old") for r in rows], "url string, verdict string")
    found = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters(df).collect()}
    for r in rows:
        assert found[r[0]] == r[1:], r[0]


def test_a_very_long_payload_in_many_segments(spark):
    html = "".join(chr(97 + i % 26) for i in range(1000)) * 3000  # 3 MB in some 190 segments
    pages = spark.createDataFrame([(1, "http://a.b/", html), (2, "http://a.b/2", html), (3, None, "x" * 40_000)], "page_id long, url string, html string")
    path = new_path(spark, "t")
    write_warc(with_revisits(pages), path)
    out = {r["record_id"].split(":")[2]: r for r in reassembled(read_warc(spark, path)).collect()}
    assert out["2"]["payload"] == html.encode() and out["1"]["record_type"] == "revisit" and out["3"]["payload"] == b"x" * 40_000
    assert not any(r["problem"] for r in out.values())


def test_own_columns_stay_in_url_filters(spark):
    rows = spark.createDataFrame([("http://ads-track.x/", 4, 5, 6)], "url string, _by_pattern int, by_pattern int, token int")
    out = url_filters(rows).first()
    assert (out["_by_pattern"], out["by_pattern"], out["token"], out["verdict"]) == (4, 5, 6, "block")


def test_of_repeated_rows_one_is_the_response(spark):
    rows = [(9, "http://a/", "same")] * 5 + [(9, "http://b/", "same"), (3, "http://a/", "same"), (None, None, "same"), (None, None, None), (None, None, None), (4, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = with_revisits(pages).collect()
    assert len(out) == len(rows) and sorted(str(r["page_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    responses = sorted((r["page_id"], r["payload_bytes"]) for r in out if r["record_type"] == "response")
    assert responses == [(4, 0), (9, 4)]
    assert all(r["refers_to"] == (9 if r["payload_bytes"] else 4) for r in out if r["record_type"] == "revisit")
    names = [(r["page_id"], r["_place"]) for r in out if r["page_id"] is not None]
    assert len(set(names)) == len(names)
    first = {r["_place"] for r in out if r["record_type"] == "response"}
    assert all(r["_first_place"] in first for r in out if r["record_type"] == "revisit")
