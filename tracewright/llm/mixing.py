"""Mixing sources to target weights (2): equal blocks of words, given to sources by Sainte-Lague and to shards of their blocks likewise.

Targets: each source gets words by weight, at most `most_repeats` times its own size; what exceeds that goes to the others by weight until
no source is above. Sources in order of their code points, null last, take the weights in turn.
Blocks: a source's documents, ordered by a hash shard and then by id, size and a hash of the text, form one stream of words, cut into blocks of
block_words. Sources get whole numbers of blocks by the highest quotients target / (2k + 1), most_repeats times their blocks at most.
A shard is shard_blocks consecutive blocks of a source; the source's quota goes to its shards by highest quotients of their blocks. In a
shard every block is taken quota div blocks times, and as many as remain, picked by a seeded permutation, once more. So no word is taken
more than most_repeats times, and a source misses its target by about a block.

Documents are ranked in hash shards whose number grows with the square root of the rows. A shard's quota is a closed form of its source's size, so
no task holds a list of a source's shards. The plan is made from a few bytes a row; texts are measured once and meet their runs by a row
number. One row for each source is all that reaches the driver, most_sources at most. Null and empty texts have no words and
take nothing; an empty table gives an empty mix; rows equal in id and text follow each other in the stream; reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..scratch import saved
from ._names import quoted
from ._skew import never_null
from ._text import Texts, slices, small_batches

WEIGHTS = (1, 2, 3)
_RUNS = pa.list_(pa.struct([("copy", pa.int32()), ("first", pa.int64()), ("words", pa.int64())]))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[int], most_repeats: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above most_repeats times its size; the excess is shared again by weight."""
    total, free = sum(sizes), set(range(len(sizes)))
    targets = [Fraction(0)] * len(sizes)
    while free:
        left = total - sum(most_repeats * sizes[i] for i in range(len(sizes)) if i not in free)
        rate = Fraction(left, sum(weights[i] for i in free))
        for i in free:
            targets[i] = rate * weights[i]
        above = {i for i in free if targets[i] > most_repeats * sizes[i]}
        for i in above:
            targets[i] = Fraction(most_repeats * sizes[i])
        if not above:
            break
        free -= above
    return [float(t) for t in targets]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1), most[i] at most; of equal quotients the earlier party's counts as higher."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = 0.0, seats / votes.sum() * 4 + 1 / votes[votes > 0].min()

    def won(rate: float) -> np.ndarray:  # all quotients of at least 1 / (2 rate)
        return np.where(votes > 0, np.minimum(most, np.floor(np.minimum(votes * rate, 1e15) + 0.5).astype(np.int64)), 0)

    while won(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if won(middle).sum() <= seats:
            low = middle
        else:
            high = middle
    got = won(low)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where((got < most) & (votes > 0), votes / (2 * got + 1), -1.0)
        got[np.argsort(-quotient, kind="stable")[: min(left, int((quotient > 0).sum()))]] += 1
    return got


def extra_blocks(seed: int, stream: int, shard: int, blocks: int, quota: int) -> np.ndarray:
    """Which of the shard's blocks are taken once more than quota div blocks times."""
    chosen = np.zeros(blocks, np.int64)
    chosen[np.random.Generator(np.random.PCG64([seed, stream, shard])).permutation(blocks)[: quota % blocks]] = 1
    return chosen


def plan_of(sizes: Sequence[int], targets: Sequence[float], block_words: int, most_repeats: int) -> np.ndarray:
    """Blocks that each source gives."""
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    return sainte_lague(np.array(targets), round(sum(sizes) / block_words), most_repeats * blocks)


def times_taken(size: int, quota: int, stream: int, first: int, last: int, block_words: int, shard_blocks: int, seed: int, cache: dict) -> np.ndarray:
    """How often each of the source's blocks first .. last is taken."""
    blocks = -(-size // block_words)
    out = []
    for shard in range(first // shard_blocks, last // shard_blocks + 1):
        if (stream, shard) not in cache:
            if len(cache) > 4096:
                cache.clear()
            n = min(shard_blocks, blocks - shard * shard_blocks)
            q = even_quota(blocks, quota, shard, shard_blocks)
            cache[stream, shard] = q // n + extra_blocks(seed, stream, shard, n, q)
        at = shard * shard_blocks
        out.append(cache[stream, shard][max(first - at, 0) : last - at + 1])
    return np.concatenate(out)


def even_quota(blocks: int, quota: int, shard: int, shard_blocks: int) -> int:
    """The shard's part of its source's quota by Sainte-Lague among the source's shards; the rounds that all blocks share are given first.

    All shards but the last are of one size, so they take turns, and only how many seats the last one gets has to be searched: its m-th has a
    quotient of rest / (2m - 1), and before it each other shard gets its seats with quotients of as much or more.
    """
    shards = -(-blocks // shard_blocks)
    rest = blocks - shard_blocks * (shards - 1)
    rounds, seats = divmod(quota, blocks)
    low, high = (seats, seats) if shards == 1 else (0, min(rest, seats))
    while low < high:  # the most seats of the last shard that come with all seats before them
        m = (low + high + 1) // 2
        ahead = min(shard_blocks, (shard_blocks * (2 * m - 1) + rest) // (2 * rest))
        if (shards - 1) * ahead + m <= seats:
            low = m
        else:
            high = m - 1
    if shard == shards - 1:
        return rounds * rest + low
    each, more = divmod(seats - low, shards - 1)
    return rounds * shard_blocks + each + (shard < more)


def _planned(rows: DataFrame, weights: Sequence[int], most_repeats: int, block_words: int, shard_blocks: int, seed: int, most_sources: int) -> DataFrame:
    """id and the struct `mix` for each of the rows (id, size, stream, doc, content): a few bytes a row, no texts."""
    spark = rows.sparkSession
    shards = max(1, int(np.ceil(np.sqrt(rows.count()))))
    # rows without words have no place in a stream, so that masses of them are dealt out by their numbers
    dealt = F.when(F.col("size") > 0, F.xxhash64("doc", "content", F.lit(seed))).otherwise(F.xxhash64("id"))
    rows = rows.withColumn("shard", F.pmod(dealt, F.lit(shards)).cast("int"))
    cells = rows.groupBy("stream", "shard").agg(F.sum("size").alias("words"))
    found = cells.groupBy("stream").agg(F.sum("words").alias("n")).limit(most_sources + 1).collect()  # one row for each source
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    found.sort(key=lambda r: (r["stream"] == "", [ord(c) for c in r["stream"]]))
    sizes = [r["n"] for r in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most_repeats)
    quotas = plan_of(sizes, targets, block_words, most_repeats)
    plan = spark.createDataFrame(
        [(r["stream"], i, int(s), float(t), int(q)) for i, (r, s, t, q) in enumerate(zip(found, sizes, targets, quotas, strict=True))],
        "stream string, place int, source_size long, target double, quota long",
    )
    before = Window.partitionBy("stream").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(plan, "stream").drop("words")
    inside = Window.partitionBy("stream", "shard").orderBy("doc", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["stream", "shard"])
    placed = placed.select("id", (F.col("before") + F.col("inside")).alias("begin"), "size", "place", "source_size", "target", "quota")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            taken, runs = [], []
            for begin, size, place, whole, quota in zip(*(batch.column(c).to_pylist() for c in ("begin", "size", "place", "source_size", "quota")), strict=True):
                total, own = 0, []
                if size and quota:
                    first, last = begin // block_words, (begin + size - 1) // block_words
                    times = times_taken(whole, quota, place, first, last, block_words, shard_blocks, seed, cache)
                    edge = np.arange(first, last + 2) * block_words
                    edge[0], edge[-1] = begin, begin + size
                    total = int((times * np.diff(edge)).sum())
                    for copy in range(int(times.max())):
                        steps = np.diff(np.concatenate([[0], (times > copy).astype(np.int8), [0]]))
                        own += [{"copy": copy, "first": int(edge[a] - begin), "words": int(edge[b] - edge[a])} for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True)]
                taken.append(total)
                runs.append(own)
            kept = ["id", "size", "source_size", "target"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(taken, pa.int64()), pa.array(runs, _RUNS)], [*kept, "taken", "runs"])

    taken = placed.mapInArrow(take, "id long, size long, source_size long, target double, taken long, runs array<struct<copy: int, first: long, words: long>>")
    return taken.select("id", F.struct("size", "source_size", "target", "taken", "runs").alias("mix"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, most_repeats: int = 3, block_words: int = 32, shard_blocks: int = 1024, seed: int = 20, most_sources: int = 100_000, carried: Sequence[str] | None = None) -> DataFrame:
    """All columns of docs (or those in `carried`) and the struct `mix`: size, source_size, target, taken, and `runs`, the taken runs of words.

    A run is (copy, first, words): in copy 0 .. most_repeats - 1 of the document, these words from word `first` on are taken. A column named
    mix is replaced; no other name of a column matters. Over most_sources sources raise an error, as each has a row on the driver.
    """
    small_batches(docs.sparkSession)
    carried = [c for c in (docs.columns if carried is None else carried) if c != "mix"]
    of = lambda c: docs[quoted(c)]
    measures = [F.monotonically_increasing_id().alias("id"), word_count(of(text)).alias("size"), never_null(of(source)).alias("stream"), F.xxhash64(of(doc_id)).alias("doc"), F.xxhash64(of(text)).alias("content")]
    rows = saved(docs.select(F.struct(*(of(c).alias(f"c{i}") for i, c in enumerate(carried))).alias("row"), *measures), "mix-rows")
    plan = saved(_planned(rows.drop("row"), weights, most_repeats, block_words, shard_blocks, seed, most_sources), "mix-runs")
    return rows.select("id", "row").join(plan, "id").select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carried)), "mix")


def mixed_texts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each copy that it takes of a document, with the words taken in that copy as its text.

    That is the whole document, or its taken runs of words, one to a line. Options are those of mixed().
    """
    names = [c for c in docs.columns if c != "mix"]
    place = names.index(text)
    rows = mixed(docs, text, **options).filter("mix.taken > 0")
    flat = rows.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)), F.col("mix.runs").alias("runs"))
    schema = StructType([StructField(f.name, StringType() if f.name == text else f.dataType) for f in docs.schema if f.name != "mix"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, f"c{place}"):
                t, runs = Texts(batch.column(place)), batch.column(len(names))
                flat_runs = runs.flatten()
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                copy, first, words = (flat_runs.field(c).to_numpy(zero_copy_only=False) for c in ("copy", "first", "words"))
                entire = words == t.n_words[row]
                word = t.word_at[row] + first
                begin = np.where(entire, t.at[row], t.starts[word])
                end = np.where(entire, t.at[row + 1], t.ends[word + words - 1])
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (copy[1:] != copy[:-1])]))
                spans = [t.bytes[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
                texts = pa.array([b"\n".join(spans[a:b]) for a, b in zip(new, [*new[1:], len(spans)], strict=True)], pa.binary()).cast(pa.string())
                out = batch.take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([texts if i == place else out.column(i) for i in range(len(names))], numbers)

    numbers = [f"c{i}" for i in range(len(names))]
    numbered = StructType([StructField(n, f.dataType) for n, f in zip(numbers, schema, strict=True)])
    return flat.mapInArrow(cut, numbered).select(*(F.col(n).alias(c) for n, c in zip(numbers, names, strict=True)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs, carried=["doc_id"]).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
