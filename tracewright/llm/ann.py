"""Approximate nearest neighbours (6): a forest of sorted hash-prefix arrays.

Rows are dealt by a hash of their id into shards. In a shard each of `trees` trees gives every vector a long hash string, a bit for the side
of each of its hyperplanes, and sorts the strings. A query descends to the longest prefixes that it shares with rows, one length in all
trees, until their ranges hold k different rows; these are measured exactly in double precision. From the angle of the k-th of them, seen
from the forest's center, follows how short prefixes have to be for a vector that near to share one with a probability of target_recall;
all trees ascend in step to that length, and the rows of these ranges are measured too. So close neighbours cost little, and where
distances hardly differ, as among random directions, much of a shard is measured.

A shard's forest is built once and its queries stream past it. Shards are at most widest_shard rows, about as many as the square root of the
rows otherwise; unique queries meet every shard, and the nearest of all shards are merged. Hyperplanes are seeded and pass through the
mean of a sample of sample_rows vectors.

Vectors that are null, zero or that hold null or non-finite components take no part, as rows or queries. Each length is searched by itself;
an id with several different vectors has k neighbours of each. Repeated query rows are one query. Rows with a query's own id are
never its neighbours; repeated rows are separate neighbours; fewer rows than asked for are all returned; no rows give no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of one shard, up to 62 bits each."""

    def __init__(self, x: np.ndarray, center: np.ndarray, trees: int, bits: int, seed: int):
        random = np.random.Generator(np.random.PCG64(seed))
        self.planes = random.normal(size=(trees, bits, x.shape[1]))
        self.center, self.bits, self.x = center, bits, x
        codes = self.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """trees x rows hash strings as integers, first bit highest."""
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for i, p in enumerate(self.planes):
            side = (x - self.center) @ p.T > 0
            for b in range(self.bits):
                out[i] = (out[i] << 1) | side[:, b]
        return out

    def depth_for(self, angle: np.ndarray, target_recall: float) -> np.ndarray:
        """The longest prefix that a vector at this angle shares with the query in some tree with the target's probability."""
        once = 1 - (1 - target_recall) ** (1 / len(self.planes))
        bit = np.maximum(1 - angle / np.pi, 1e-9)
        return np.clip(np.floor(np.log(once) / np.minimum(np.log(bit), -1e-12)), 0, self.bits).astype(np.int64)

    def nearest(self, q: np.ndarray, own: list[np.ndarray], ids: np.ndarray, k: int, target_recall: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the places of its k nearest rows found, besides its own rows; their distances; and how many rows were measured."""
        codes, n = self.codes(q), len(self.x)
        low, high = (np.zeros((self.bits + 1, *codes.shape), np.int64) for _ in range(2))
        for depth in range(self.bits + 1):
            rest = self.bits - depth
            for i, c in enumerate(codes):
                low[depth, i] = np.searchsorted(self.sorted[i], (c >> rest) << rest, side="left")
                high[depth, i] = np.searchsorted(self.sorted[i], ((c >> rest) + 1) << rest, side="left")
        for j in range(len(q)):
            far, hit, least = np.full(n, np.inf), np.zeros(n, bool), min(k, n - len(own[j]))

            def measure(depth: int, j: int = j, far: np.ndarray = far, hit: np.ndarray = hit) -> int:
                new = np.zeros(n, bool)
                for i in range(len(codes)):
                    new[self.order[i, low[depth, i, j] : high[depth, i, j]]] = True
                new[own[j]] = False
                new &= ~hit
                at = np.flatnonzero(new)
                far[at] = np.sqrt(((self.x[at] - q[j]) ** 2).sum(axis=1))
                hit[at] = True
                return int(hit.sum())

            held = (high[:, :, j] - low[:, :, j]).max(axis=1)
            depth = int(np.flatnonzero(held >= min(k, held[0]))[-1])
            while measure(depth) < least and depth:
                depth -= 1
            if least and depth:
                kth = np.argpartition(far, least - 1)[least - 1]
                a, b = q[j] - self.center, self.x[kth] - self.center
                cosine = (a @ b) / max(np.sqrt((a @ a) * (b @ b)), 1e-300)
                enough = int(self.depth_for(np.arccos(np.clip(cosine, -1, 1)), target_recall))
                if enough < depth:
                    measure(enough)
            at = np.flatnonzero(hit)
            best = at[np.lexsort((ids[at], far[at]))[:k]]
            yield best, far[best], len(at)


def shards_of(rows: int, widest_shard: int) -> int:
    """About the square root of the rows, so that work is spread and queries meet few shards, but none over widest_shard."""
    return max(1, round((rows / 1024) ** 0.5), -(-rows // widest_shard))


def nearest(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = 64, bits: int = 24, target_recall: float = 0.95, widest_shard: int = 1 << 17, sample_rows: int = 2000, seed: int = 6) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows found."""
    spark = rows.sparkSession
    take = lambda df: df.filter(usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows, queries = take(rows), take(queries).dropDuplicates(["id", "v"])
    id_type = rows.schema["id"].dataType.simpleString()
    empty = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    counts = lambda df: {r["n"]: r["count"] for r in df.groupBy(F.size("v").alias("n")).count().collect()}  # noqa: E731 - a row for each length
    stored = counts(rows)
    if not stored:
        return spark.createDataFrame([], empty)
    centers = {}
    for n in stored:
        sample = rows.filter(F.size("v") == n).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column(0).combine_chunks()  # sample_rows at most
        centers[n] = np.mean(sample.flatten().to_numpy().reshape(-1, n), axis=0)
    shards = F.element_at(F.create_map(*(F.lit(x) for n, c in stored.items() for x in (n, shards_of(c, widest_shard)))), F.size("v"))
    own = rows.select(F.size("v").alias("n"), F.pmod(F.xxhash64("id", F.lit(seed)), shards).cast("int").alias("shard"), F.lit(False).alias("asked"), "id", "v")
    asked = queries.filter(F.size("v").isin(list(stored))).select(F.size("v").alias("n"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(True).alias("asked"), "id", "v")
    met = own.unionByName(asked).repartition("n", "shard").sortWithinPartitions("n", "shard", "asked", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest, ids = None, [], None, None
        for whole in batches:
            key = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), whole.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                n, shard, is_query = key[:, a].tolist()
                part = whole.slice(a, b - a)
                names, v = part.column(3).to_numpy(zero_copy_only=False), part.column(4).flatten().to_numpy().reshape(-1, n)
                if now != (n, shard):
                    now, held, forest, ids = (n, shard), [], None, None
                if not is_query:
                    held.append((names, v))
                    continue
                if forest is None and held:
                    ids, x = (np.concatenate(p) for p in zip(*held, strict=True))
                    forest, held = Forest(x, centers[n], trees, bits, seed), []
                if forest is None:
                    continue  # no row in this shard
                for at in range(0, b - a, 64):
                    q = v[at : at + 64]
                    mine = [np.flatnonzero(ids == i) for i in names[at : at + 64]]
                    places, far = [], []
                    for best, distance, _ in forest.nearest(q, mine, ids, k, target_recall):
                        places.append(best)
                        far.append(distance)
                    of = np.repeat(np.arange(len(q)), [len(p) for p in places])
                    block = part.slice(at, 64)
                    yield pa.RecordBatch.from_arrays([block.column(3).take(pa.array(of)), block.column(4).take(pa.array(of)), pa.array(ids[np.concatenate(places)], block.column(3).type), pa.array(np.concatenate(far))], ["query_id", "v", "vec_id", "score"])

    found = met.mapInArrow(search, f"query_id {id_type}, v array<double>, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id", "v").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))
