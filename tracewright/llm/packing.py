"""Packing (8): token sequences of a fixed window from whole documents, with hardly any padding.

Each task packs its own rows in lots of about lot_tokens tokens, so nothing is shuffled and memory doesn't grow with the input. In a lot,
a document's whole windows stand alone. For the remainders, length combinations of two or three that fill the window exactly are
enumerated; non-negative least squares finds how often to repeat each so that together they use up the histogram of lengths; the counts
are rounded down to what is there. Remainders left over are packed greedily, longest first, each cut where its sequence is full. What the
last sequence of a lot lacks is carried into the next lot; a task pads one sequence at most, its last.

A null or empty text has one id, the end. Rows repeat as often as they come in. Reruns over the same partitions give the same rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import offsets_of, slices, small_batches

PIECES = "doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers JSON file with the tokens that it adds, which count as themselves wherever a text holds their strings.

    The ranks of the same vocabulary are read from the .tiktoken file beside it, as their encoder is five times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        added = {token["content"]: token["id"] for token in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def combinations(counts: np.ndarray, window: int, deep_bins: int) -> np.ndarray:
    """Rows of two or three lengths (0: none) that sum to window: every pair at hand, and triples with two of the commonest lengths."""
    there = np.flatnonzero(counts)
    a = there[(2 * there <= window) & (counts[window - there] > 0)]
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    top = there[np.argsort(-counts[there], kind="stable")[:deep_bins]]
    x, y = (v.ravel() for v in np.meshgrid(top, top, indexing="ij"))
    z = window - x - y
    fits = (x <= y) & (z > 0)
    fits[fits] = counts[z[fits]] > 0
    triples = np.unique(np.sort(np.stack([x, y, z], axis=1)[fits], axis=1), axis=0)
    return np.concatenate([pairs, triples.reshape(-1, 3)]).astype(np.int64)


def nonnegative_counts(combos: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A holding how often each combination uses each length, by multiplicative descent."""
    column, length = np.nonzero(combos)[0], combos[combos > 0]
    m, n = len(combos), len(counts)
    down = lambda v: np.bincount(column, weights=v[length], minlength=m)
    target = down(counts.astype(float))
    x = np.full(m, counts.sum() / max(1, 3 * m))
    for _ in range(rounds):
        x *= target / np.maximum(down(np.bincount(length, weights=x[column], minlength=n)), 1e-12)
    return x


def pack(lengths: np.ndarray, window: int = 1024, deep_bins: int = 64) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences; only the last sequence can have room left."""
    out, used_sequences = [], 0
    whole, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    out.append(np.stack([doc, nth * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)]))
    used_sequences = len(doc)
    order = np.argsort(rest, kind="stable")
    bins = np.searchsorted(rest[order], np.arange(window + 1))
    left = np.diff(bins)
    left[0] = 0
    taken = np.zeros(window, np.int64)
    if left.any() and len(combos := combinations(np.append(left, 0), window, deep_bins)):
        wanted = nonnegative_counts(combos, left)
        for i in np.argsort(-wanted, kind="stable"):
            members = [int(a) for a in combos[i] if a]
            room = min((left[a] - taken[a]) // members.count(a) for a in members)
            times = min(room, int(wanted[i] + 0.5))
            if times < 1:
                continue
            offset = 0
            for a in members:
                docs = order[bins[a] + taken[a] : bins[a] + taken[a] + times]
                taken[a] += times
                out.append(np.stack([docs, whole[docs] * window, np.full(times, a), used_sequences + np.arange(times), np.full(times, offset)]))
                offset += a
            used_sequences += times
    docs = np.concatenate([np.zeros(0, np.int64), *(order[bins[a] + taken[a] : bins[a + 1]] for a in range(window - 1, 0, -1) if left[a] > taken[a])])
    if len(docs):
        end = np.cumsum(rest[docs])
        begin = end - rest[docs]
        cut = np.minimum(end, (begin // window + 1) * window)
        second = cut < end
        out.append(np.stack([docs, whole[docs] * window, cut - begin, used_sequences + begin // window, begin % window]))
        s = docs[second]
        out.append(np.stack([s, whole[s] * window + (cut - begin)[second], (end - cut)[second], used_sequences + cut[second] // window, np.zeros(len(s), np.int64)]))
        used_sequences += -(-int(end[-1]) // window)
    return np.concatenate(out, axis=1), used_sequences


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 1024, vocabulary: str = "byte_bpe_50k", end_id: int = 0, lot_tokens: int = 3_000_000) -> DataFrame:
    """One row for each piece, with its ids as unsigned little-endian 32-bit integers."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = PIECES.format(id_type=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base, done = encoder(vocabulary), TaskContext.get().partitionId() << 40, 0
        lot: list[tuple] = []  # (document's id, start of what is left of it, its ids, its length)
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, size, lot
            pieces, sequences = pack(np.array([len(x[2]) - x[1] for x in lot], np.int64), window)
            room = pieces[3] == sequences - 1
            carried = [] if last or pieces[2][room].sum() == window else list(zip(pieces[0][room], pieces[1][room], strict=True))
            later = [(*lot[d][:1], lot[d][1] + s, lot[d][2][: lot[d][1] + s + n], lot[d][3]) for (d, s), n in zip(carried, pieces[2][room], strict=True)] if carried else []
            if carried:
                pieces, sequences = pieces[:, ~room], sequences - 1
            for at in range(0, pieces.shape[1], 2000):
                d, s, n, q, o = pieces[:, at : at + 2000]
                begin = s + np.array([lot[i][1] for i in d], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lot[i][0] for i in d], types[0]),
                        pa.array(begin),
                        pa.array(n),
                        pa.array(np.array([lot[i][3] for i in d], np.int64)),
                        pa.array(base + done + q),
                        pa.array(o),
                        pa.array([lot[i][2][b : b + k].astype("<u4").tobytes() for i, b, k in zip(d, begin, n, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            done += sequences
            lot, size = later, sum(len(x[2]) - x[1] for x in later)

        types = [None]
        for whole in batches:
            types[0] = whole.column(0).type
            for batch in slices(whole, "text"):
                texts = offsets_of(batch.column(1))[1].to_pylist()
                for key, one in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids = np.append(code.encode_to_numpy(one, allowed_special="all"), end_id).astype(np.uint16 if code.n_vocab <= 65536 else np.uint32)
                    lot.append((key, 0, ids, len(ids)))
                    size += len(ids)
                    if size >= lot_tokens:
                        yield from flush(last=False)
        if lot:
            yield from flush(last=True)

    return docs.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
