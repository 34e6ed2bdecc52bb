"""Token counts (13): how many tokens a tokenizer gives each whole text, with no shuffle of pre-tokens.

A byte-level BPE merges inside pre-tokens only, so a text's count is the sum over its pre-tokens. Two passes over the texts:

1. Each task keeps a summary of its commonest pre-tokens (Misra and Gries 1982; mergeable by Agarwal et al. 2012), `table_entries` at most. A
   task returns its summary as one row; rows are merged `fan_in` at a time. A pre-token with more than 1 in `table_entries` of all pre-tokens
   of all texts is certain to stay. Summaries only decide what is fast: counts don't depend on them.
2. The summary's pre-tokens are counted once by the library and broadcast as a hash table of 64-bit hashes, byte lengths and token counts, a
   size that doesn't depend on the data. Each task looks all its pre-tokens up at once; a miss is counted by the library and kept in its
   worker's cache, `cache_entries` at most, which starts anew when it is full.

Pre-tokens are found for whole Arrow batches in numpy. Which code points are letters, numbers or white space is asked of the tokenizer itself.
A pre-token of over 64 bytes always goes to the library. Hashes are compared together with byte lengths: that another pre-token passes for one
of the table has a probability of about 1e-15 for each different pre-token. Very long texts are taken in parts of about 4 MB, cut before a
space or line feed that follows an ASCII character; a text without any such place is one part.

Strings of added tokens inside texts count as one token each, as the library's default has it. Vocabularies of another kind (sentencepiece
models, other pre-tokenizers) have no such pre-tokens: the library counts their whole texts. A null text is empty: 0 bytes, 0 tokens.
Bytes that aren't UTF-8 count as U+FFFD. Rows repeat as often as they come in; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from ._text import Texts, offsets_of, slices, small_batches

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Longest pre-token of the table, in bytes.
WIDEST = 64
#: Longest part of a text, in bytes, where there is a place to cut.
PART = 1 << 22


@dataclass
class Vocabulary:
    """What is known of a vocabulary file: its path and, for byte-level BPE, the kind of every code point and the strings of added tokens."""

    file: str
    classes: np.ndarray | None
    added: tuple[bytes, ...] = ()


def library(file: str) -> Callable[[list[str]], list[int]]:
    """Token counts of whole texts by the vocabulary's own library, without begin, end or added special tokens."""
    import public_tokenizers

    path = public_tokenizers.path(file)
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def vocabulary_of(file: str, block: int = 256) -> Vocabulary:
    """Reads the file's settings. Classes come from the pre-tokenizer: a code point has the kind of the letter, number or sign that it joins."""
    import public_tokenizers

    if not file.endswith(".json"):
        return Vocabulary(file, None)
    with open(public_tokenizers.path(file), encoding="utf-8") as f:
        settings = json.load(f)
    first, added = settings.get("pre_tokenizer") or {}, settings.get("added_tokens") or []
    plain = not settings.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    simple = all(" " not in t["content"] and "\n" not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    if not (plain and simple and settings["model"]["type"] == "BPE"):
        return Vocabulary(file, None)
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    classes = np.full(0x110000, SPACE, np.uint8)
    for start in range(0, len(classes), block):
        points = [c for c in range(start, start + block) if not 0xD800 <= c < 0xE000]
        together = "".join(map(chr, points))
        for kind, sample in ((OTHER, "!"), (LETTER, "a")):  # most blocks are all of one kind
            if len(split(sample + together)) == 1:
                classes[points] = kind
                break
        else:
            for kind, sample in ((OTHER, "!"), (LETTER, "a"), (NUMBER, "1")):
                joins = [begin // 3 for _, (begin, end) in split("".join(f"{sample}{chr(c)}\n" for c in points)) if end - begin == 2 and begin % 3 == 0]
                classes[np.array(points, np.int64)[joins]] = kind
    return Vocabulary(file, classes, tuple(t["content"].encode() for t in added))


def piece_starts(codes: np.ndarray, sections: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as flags over the code points; sections holds where texts (none empty) start, and the end of the last.

    The pattern of byte-level BPE: contractions, runs of letters, of numbers and of other signs, each with one space before it; of white space
    before anything else the last character stands alone unless it is that space.
    """
    n = len(codes)
    kind = classes[codes]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[sections[:-1]] = True
    last = np.zeros(n, bool)
    last[sections[1:] - 1] = True
    edge = np.zeros(n, bool)  # the last white space before something else
    edge[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE)
    edge &= ~last
    start |= edge
    start[np.flatnonzero(edge & (codes == 32)) + 1] = False
    quote = np.flatnonzero((codes == 39) & start & ~last)
    after = codes[quote + 1]
    one = quote[np.isin(after, [ord(c) for c in "stmd"])]
    longer = ~last[quote + 1]
    quote, after = quote[longer], after[longer]
    then = codes[quote + 2]
    two = quote[((then == ord("e")) & ((after == ord("r")) | (after == ord("v")))) | ((then == ord("l")) & (after == ord("l")))]
    for at, size in ((one, 2), (two, 3)):
        start[at + 1] = False
        ends = at + size
        start[ends[ends < n]] = True
    return start


class Pieces(Texts):
    """Pre-tokens of consecutive texts: byte spans, hashes, and which of them are an added token's string."""

    def __init__(self, data: np.ndarray, at: np.ndarray, v: Vocabulary):
        self.bytes, self._sums = data, None
        raw = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        whole = np.zeros((0, 2), np.int64)
        if any(token in raw for token in v.added):
            found = np.array([m.span() for m in re.finditer(b"|".join(map(re.escape, v.added)), raw)], np.int64)
            inside = np.searchsorted(at, found[:, 0], side="right") == np.searchsorted(at, found[:, 1] - 1, side="right")
            whole = found[inside]
        cuts = np.unique(np.concatenate([at, whole.ravel()]))
        begin = np.zeros(0, np.int64)
        if len(codes):
            sections = np.searchsorted(lead, cuts)
            start = piece_starts(codes, sections, v.classes)
            for a, b in np.searchsorted(lead, whole):
                start[a + 1 : b] = False
            begin = lead[start]
        self.begin, self.end = begin, np.append(begin[1:], len(data))[: len(begin)]
        self.added = np.isin(begin, whole[:, 0])
        self.short = (self.end - self.begin <= WIDEST) & ~self.added
        self.of_text = np.searchsorted(begin, at)
        self.hash = self.span_hash(self.begin, self.end)


def parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, edges of texts and number of the first text, for all texts of a column together or for each part of a very long one."""
    at, column = offsets_of(column)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(at[:-1], at[1:], strict=True)]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    if len(data) <= PART or len(at) > 2:
        yield data, at, 0
        return
    begin = 0
    while begin < len(data):
        window, end = begin + PART, len(data)
        while window < len(data):
            ahead = data[window - 1 : window + PART]
            fits = np.flatnonzero(((ahead[1:] == 32) | (ahead[1:] == 10)) & (ahead[:-1] > 32) & (ahead[:-1] < 127))
            if len(fits):
                end = window + int(fits[0])
                break
            window += PART
        yield data[begin:end], np.array([0, end - begin]), 0
        begin = end


@dataclass
class Table:
    """Open addressing with linear probing: hashes, byte lengths (0: free) and token counts of each slot."""

    hashes: np.ndarray
    widths: np.ndarray
    tokens: np.ndarray
    probes: int

    @classmethod
    def of(cls, pieces: list[bytes], tokens: list[int]) -> Table:
        size = 1 << max(4, (8 * len(pieces)).bit_length())
        out = cls(np.zeros(size, np.uint64), np.zeros(size, np.uint8), np.zeros(size, np.uint8), 0)
        for h, piece, n in zip(_hashes(pieces), pieces, tokens, strict=True):
            slot, tries = int(h) & (size - 1), 1
            while out.widths[slot]:
                slot, tries = (slot + 1) & (size - 1), tries + 1
            out.hashes[slot], out.widths[slot], out.tokens[slot], out.probes = h, len(piece), n, max(out.probes, tries)
        return out

    def lookup(self, h: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Token counts, 0 where a piece isn't in the table."""
        found, left, mask = np.zeros(len(h), np.int64), np.arange(len(h)), np.uint64(len(self.hashes) - 1)
        for k in range(self.probes):
            slot = (h[left] + np.uint64(k)) & mask
            there = self.widths[slot] > 0
            left, slot = left[there], slot[there]
            hit = (self.hashes[slot] == h[left]) & (self.widths[slot] == widths[left])
            found[left[hit]] = self.tokens[slot[hit]]
            left = left[~hit]
        return found


def _hashes(pieces: list[bytes]) -> np.ndarray:
    spans = Pieces.__new__(Pieces)
    spans.bytes, spans._sums = np.frombuffer(b"".join(pieces), np.uint8), None
    edge = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return spans.span_hash(edge[:-1], edge[1:])


def commonest(pieces: list[bytes], counts: np.ndarray, most: int) -> tuple[list[bytes], np.ndarray]:
    """The summary of added-up summaries: the `most` commonest pieces (ties by bytes), their counts less that of the first left out."""
    total: dict[bytes, int] = {}
    for piece, n in zip(pieces, counts.tolist(), strict=True):
        total[piece] = total.get(piece, 0) + n
    order = sorted(total.items(), key=lambda item: (-item[1], item[0]))
    less = order[most][1] if len(order) > most else 0
    kept = [(piece, n - less) for piece, n in order[:most] if n > less]
    return [piece for piece, _ in kept], np.array([n for _, n in kept], np.int64)


def summaries(docs: DataFrame, v: Broadcast, most: int) -> DataFrame:
    """One row for each task with text: its number, its commonest pre-tokens and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        counts = np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for data, at, _ in parts(batch.column("text")):
                    p = Pieces(data, at, v.value)
                    short = np.flatnonzero(p.short)
                    _, first, n = np.unique(p.hash[short], return_index=True, return_counts=True)
                    raw, own = data.tobytes(), short[first]
                    pieces += [raw[a:b] for a, b in zip(p.begin[own].tolist(), p.end[own].tolist(), strict=True)]
                    counts = np.concatenate([counts, n])
                    if len(pieces) > 16 * most:
                        pieces, counts = commonest(pieces, counts, most)
        if pieces:
            pieces, counts = commonest(pieces, counts, most)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pieces], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["part", "pieces", "counts"])

    return docs.select("text").mapInArrow(run, "part long, pieces array<binary>, counts array<long>")


def frequent_pieces(docs: DataFrame, v: Broadcast, most: int, fan_in: int = 64) -> list[bytes]:
    """The commonest pre-tokens of all texts, by merging summaries of fan_in tasks at a time; fan_in summaries reach the driver at most."""

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        pieces, counts = commonest([p for x in own["pieces"] for p in x], np.concatenate(list(own["counts"])), most)
        return pd.DataFrame({"part": [int(own["part"].iloc[0]) // fan_in], "pieces": [pieces], "counts": [counts]})

    rows = saved(summaries(docs, v, most), "summaries")
    last = rows.agg(F.max("part")).first()[0]
    while last is not None and last >= fan_in:
        rows = saved(rows.groupBy(F.expr(f"part div {fan_in}")).applyInPandas(merge, rows.schema), "summaries")
        last //= fan_in
    held = [(bytes(p), n) for r in rows.orderBy("part").collect() for p, n in zip(r["pieces"], r["counts"], strict=True)]  # fan_in rows at most
    return commonest([p for p, _ in held], np.array([n for _, n in held], np.int64), most)[0]


#: Of each worker process: counts of pieces that were missed before, by vocabulary.
_cache: dict[str, dict[bytes, int]] = {}
_library: dict[str, Callable[[list[str]], list[int]]] = {}


def _counter(file: str) -> Callable[[list[str]], list[int]]:
    if file not in _library:
        _library[file] = library(file)
    return _library[file]


def missed(pieces: list[bytes], file: str, cache_entries: int) -> list[int]:
    """Token counts of pieces: from the worker's cache, or by the library."""
    cache = _cache.setdefault(file, {})
    new = list({p for p in pieces if p not in cache})
    fresh = dict(zip(new, _counter(file)([p.decode("utf-8") for p in new]), strict=True)) if new else {}
    out = [fresh[p] if p in fresh else cache[p] for p in pieces]
    if len(cache) + len(fresh) > cache_entries:
        cache.clear()
    cache.update(list((p, n) for p, n in fresh.items() if len(p) <= WIDEST)[:cache_entries])
    return out


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json", limit: int = 512, table_entries: int = 1 << 14, cache_entries: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = vocabulary_of(vocabulary)
    v = spark.sparkContext.broadcast(known)
    table = None
    if known.classes is not None:
        common = frequent_pieces(rows, v, table_entries)
        tokens = library(vocabulary)([p.decode("utf-8") for p in common]) if common else []
        table = spark.sparkContext.broadcast(Table.of(common, tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                total = np.zeros(batch.num_rows, np.int64)
                for data, at, first in parts(batch.column("text")):
                    if table is None:
                        raw = data.tobytes()
                        total[first : first + len(at) - 1] += _counter(vocabulary)([raw[a:b].decode("utf-8") for a, b in zip(at[:-1], at[1:], strict=True)])
                        continue
                    p = Pieces(data, at, v.value)
                    n = table.value.lookup(p.hash, np.where(p.short, p.end - p.begin, 0))
                    n[p.added] = 1
                    left, raw = np.flatnonzero(n == 0), data.tobytes()
                    n[left] = missed([raw[a:b] for a, b in zip(p.begin[left].tolist(), p.end[left].tolist(), strict=True)], vocabulary, cache_entries)
                    total[first : first + len(at) - 1] += p.per_text(n, p.of_text)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
