"""WARC archives (1): written by Spark's text sink, read back, segments reassembled and chunked framing decoded.

Writing: a payload over segment_bytes is split; the first record is `response` with WARC-Segment-Number 1, the others are `continuation`
records that name it in WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. HTTP bodies have chunked transfer framing. Each
record is a row of a text sink whose line separator is the record separator, so archives go to any file system that Spark writes.
Reading: archives are read whole (file_bytes keeps them small) and cut by Content-Length, so payloads may hold anything. Whole records
need no shuffle; only segments are grouped, by their origin, ordered by number and checked for gaps and against the total length.
Records with missing segments or broken framing keep a null payload and say so in `problem`.

Equal payloads: the page with the largest id is `response`, the others are `revisit` of it (null ids come after all others and can
only be revisited if the whole group has none; of repeated rows with the largest id one is the response). Groups are pre-aggregated by
digest and joined back by a join that deals out the rows of the digests with most copies. Null payloads count as empty. An empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import new_path, saved
from ._skew import lookup
from ._text import small_batches

CRLF = b"\r\n"
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("declared_bytes", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("origin_id", T.StringType()),
        T.StructField("total_length", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: 20 bits of the hex form at a time, in another alphabet."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX, _BASE32)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row; _place and _first_place tell rows of an id apart.

    A row's place is a hash of it, so it is the same wherever the row is read again. Of repeated rows that all could be the response one is, and
    the others are counted and written as that many revisits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("_place", F.xxhash64("page_id", F.col("url").isNull(), "url", "payload_digest"))
    same = rows.groupBy("payload_digest", "page_id", "_place").agg(F.count(F.lit(1)).alias("n"), F.first("url").alias("url"), F.first("payload_bytes").alias("bytes"))
    groups = same.groupBy("payload_digest").agg(F.max(F.struct("page_id", "_place", "n", "url", "bytes")).alias("first"), F.sum("n").alias("copies"))
    groups = saved(groups, "payloads")
    joined = lookup(rows, groups, "payload_digest", "copies", "_place")
    is_first = F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first._place") == F.col("_place"))
    repeated = groups.filter("first.n > 1")
    out = joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("first.page_id")).alias("refers_to"),
        "_place", F.when(~is_first, F.col("first._place")).alias("_first_place"), (is_first & (F.col("first.n") > 1)).alias("again"),
    )
    if repeated.isEmpty():
        return out.drop("again")
    again = repeated.select("*", F.explode(F.sequence(F.lit(2).cast("long"), F.col("first.n"))).alias("k")).select(
        F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("first.bytes").alias("payload_bytes"), "payload_digest",
        F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to"), F.xxhash64("first._place", "k").alias("_place"), F.col("first._place").alias("_first_place"),
    )
    one = out.filter("again").dropDuplicates(["payload_digest"])
    return out.filter("NOT again").drop("again").unionByName(one.drop("again")).unionByName(again)


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes | None:
    """The payload in chunked framing; None if the framing is broken. Trailers and chunk extensions are skipped."""
    at, parts = 0, []
    while True:
        line = body.find(CRLF, at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].partition(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(parts) if body.find(CRLF, at) >= 0 else None
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    head, end, body = block.partition(CRLF + CRLF)
    if not end:
        return None
    fields = dict(_field(line) for line in head.split(CRLF)[1:])
    return dechunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"").lower() else body


def _field(line: bytes) -> tuple[bytes, bytes]:
    name, _, value = line.partition(b":")
    return name.strip().lower(), value.strip()


def _header(**fields: object) -> bytes:
    lines = [b"WARC/1.1", *(f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items() if v is not None)]
    return CRLF.join(lines) + CRLF + CRLF


def write_warc(rows: DataFrame, path: str, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, file_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    """Archives under path with a record, or its segments, for each row of with_revisits()."""
    schema = "record binary"
    small_batches(rows.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in batch.to_pylist():
                before = len(out)
                uri = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A") or None
                name = f"<urn:page:{'' if r['page_id'] is None else r['page_id']}:{r['_place']}>"
                same = {"WARC_Target_URI": uri, "WARC_Date": "2024-01-01T00:00:00Z", "WARC_Payload_Digest": f"sha1:{r['payload_digest']}"}
                if r["record_type"] == "revisit":
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["payload_bytes"]
                    refers = f"<urn:page:{'' if r['refers_to'] is None else r['refers_to']}:{r['_first_place']}>"
                    head = _header(WARC_Type="revisit", WARC_Record_ID=name, **same, WARC_Refers_To=refers, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http;msgtype=response", Content_Length=len(block))
                    out.append(head + block)
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(r["payload"], chunk_bytes)
                    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
                    for k, part in enumerate(parts, 1):
                        split = {} if len(parts) == 1 else {"WARC_Segment_Number": k}
                        if k > 1:
                            split |= {"WARC_Segment_Origin_ID": name} | ({"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {})
                        kind = {"WARC_Type": "response", "WARC_Record_ID": name} if k == 1 else {"WARC_Type": "continuation", "WARC_Record_ID": f"{name[:-1]}:{k}>"}
                        out.append(_header(**kind, **same, **split, Content_Type="application/http;msgtype=response", Content_Length=len(part)) + part)
                size += sum(map(len, out[before:]))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(encode, schema)
    per_file = max(1, file_bytes // (segment_bytes + 1024))
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def parsed(content: bytes) -> Iterator[dict]:
    """The records of one archive, in order, cut by their Content-Length."""
    at = 0
    while at < len(content):
        end = content.find(CRLF + CRLF, at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        f = {k: v.decode() for k, v in map(_field, content[at:end].split(CRLF)[1:])}
        start = end + 4
        stop = start + int(f[b"content-length"])
        number = lambda name: int(f[name]) if name in f else None
        yield {
            "record_id": f.get(b"warc-record-id"), "record_type": f.get(b"warc-type"), "target_uri": f.get(b"warc-target-uri"), "refers_to": f.get(b"warc-refers-to"),
            "declared_digest": f.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, "declared_bytes": None, "segment": number(b"warc-segment-number"),
            "origin_id": f.get(b"warc-segment-origin-id"), "total_length": number(b"warc-segment-total-length"), "block": content[start:stop],
        }
        at = stop
        while content.startswith(CRLF, at):
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each WARC record of the archives under path."""
    arrow = pa.schema([(f.name, pa.binary() if f.name == "block" else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in RECORD])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                content = content.as_py()
                for r in parsed(gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content):
                    if r["record_type"] == "revisit":
                        fields = dict(map(_field, r["block"].partition(CRLF + CRLF)[0].split(CRLF)[1:]))
                        r["declared_bytes"] = int(fields[b"content-length"]) if b"content-length" in fields else None
                    rows.append(r)
                    size += len(r["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole responses and revisits with their decoded payload (revisits: null) and what is wrong with it, if anything."""
    single = records.filter(F.col("segment").isNull()).withColumn("problem", F.lit(None).cast("string"))
    names = ["record_id", "record_type", "target_uri", "refers_to", "declared_digest", "declared_bytes"]
    parts = records.filter(F.col("segment").isNotNull()).withColumn("_key", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    joined = parts.groupBy("_key").agg(
        *(F.max(F.when(first, F.col(n))).alias(n) for n in names),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    blocks = F.transform("parts", lambda p: p["block"])
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.octet_length(b))
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    whole = joined.withColumn("blocks", blocks).withColumn(
        "problem", F.when(~gapless, "missing or repeated segment").when(F.col("total_length").isNull(), "no total length").when(length != F.col("total_length"), "wrong total length")
    )
    keep = [*names, "blocks", "problem"]
    both = single.withColumn("blocks", F.array("block")).select(*keep).unionByName(whole.select(*keep))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate([*names, "payload", "problem"])}
        for batch in batches:
            payloads, problems = [], []
            for kind, blocks_, problem in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("record_type", "blocks", "problem")), strict=True):
                problem, found = problem.as_py(), None
                if problem is None and kind.as_py() == "response":
                    found = http_payload(b"".join(x or b"" for x in blocks_.as_py()))
                    problem = "broken framing" if found is None else None
                payloads.append(found)
                problems.append(problem)
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"payload": pa.array(payloads, pa.binary()), "problem": pa.array(problems, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in at], list(at))

    schema = T.StructType([*(RECORD[n] for n in names), T.StructField("payload", T.BinaryType()), T.StructField("problem", T.StringType())])
    return both.mapInArrow(decode, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_warc(with_revisits(pages), path)
    found = reassembled(read_warc(spark, path))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(pages.schema["page_id"].dataType)
    full = F.col("payload").isNotNull()
    return found.select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("payload"))).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "problem",
    )


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS nth FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM m
"""
