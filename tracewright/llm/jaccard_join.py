"""N-gram Jaccard join (3): links between documents whose sets of n-word shingles have a Jaccard similarity of at least `threshold`.

Equal texts are one class and take part once. A class's signature has `trees` labels of `label_values` min-hashes, each label a path in a
prefix trie. The forest is kept as sorted arrays: a tree's labels in order, cut into ranges of even size whatever their skew, so that classes
which share a prefix follow each other and the longest one that a class shares with any other is that with a neighbour.

Matches start at whole labels and their prefixes are shortened for each class by what is found: the number of trees in which it meets a
neighbour estimates their similarity s, 1 - (1 - s ** d) ** trees is how likely such a pair meets by prefixes of d values, and by the
inverses of these probabilities the recall of the class's matches at depth d is estimated. A class keeps the longest prefixes whose estimate
reaches target_recall. No prefix gets shorter than that at which even pairs at the threshold itself reach it (prefix_depth), so a class
with faint evidence only is searched as deep as that. The rows of a range that share as much as the faintest class in it wants hang together.

Linked classes form candidate groups, and in each group every pair is compared exactly, by the intersections of its shingle sets: large
groups are cut into blocks and each pair of blocks is one task, which returns one row for each class, its number of links and its place in
the task's components. A large group of which most pairs have little in common is compared shingle by shingle instead, if that makes fewer than
half the pairs: sets as near as the threshold share one of their first few shingles by hash (prefix filter), so classes that share
none of these can't be linked, and a pair that shares several counts in the first. Both ways find the same links, so a group's size
decides its cost only. No row is made for a pair. The work in a group grows with the square of its different texts (or of those with a
shingle in common), spread evenly over tasks; a set is sent once for each block of its group, or for each such shingle.

A text of 1 to n - 1 words has one shingle, all its words. Texts without words (null, empty, blank) have no links and stand alone. Sets are
of 64-bit hashes of whole texts' shingles. Repeated rows are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from ._components import components
from ._skew import lookup, never_null
from ._text import Texts, slices, small_batches


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (with repeats) and each one's text, in order of the texts."""
    words = t.word_hash()
    h, at = t.ngrams(n, words)
    doc = t.doc[at]
    short = [k for k in range(1, n) if (t.n_words == k).any()]
    for k in short:
        more, where = t.ngrams(k, words)
        own = t.n_words[t.doc[where]] == k
        h, doc = np.concatenate([h, more[own]]), np.concatenate([doc, t.doc[where][own]])
    if short:
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def minhash_labels(t: Texts, n: int, count: int, seed: int) -> list[bytes | None]:
    """`count` min-hashes of each text as 16-bit big-endian integers; None for a text without words."""
    random = np.random.Generator(np.random.PCG64(seed))
    a = random.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = random.integers(0, 2**32, count, dtype=np.uint32)
    h, doc = shingles(t, n)
    out: list[bytes | None] = [None] * t.n
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    at = 0
    while at < len(first):  # some 100,000 shingles at a time
        stop = max(at + 1, int(np.searchsorted(first, first[at] + 100_000)))
        end = first[stop] if stop < len(first) else len(h)
        part, starts = h[first[at] : end], first[at:stop] - first[at]
        halves = (part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32))
        least = np.empty((len(starts), count), ">u2")
        for i in range(count):
            least[:, i] = (np.minimum.reduceat(halves[i % 2] * a[i] + b[i], starts) & np.uint32(0xFFFF)).astype(np.uint16)
        raw = least.tobytes()
        for k in range(len(starts)):
            out[int(doc[first[at + k]])] = raw[2 * count * k : 2 * count * (k + 1)]
        at = stop
    return out


def prefix_depth(threshold: float, trees: int, longest: int, target_recall: float) -> int:
    """Shortens the prefix, from whole labels on, until pairs at the threshold meet with the target's probability."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target_recall:
        depth -= 1
    return depth


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits of hash of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(0x51ED270B), whole)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of every left with every right set, as a matrix."""
    same = left is right
    sizes = [np.array([len(s) for s in sets], np.int64) for sets in (left, right)]
    values, place = np.unique(np.concatenate(left if same else [*left, *right]), return_inverse=True)
    cut = int(sizes[0].sum())
    places = (place, place) if same else (place[:cut], place[cut:])
    in_left, in_right = (np.bincount(x, minlength=len(values)) for x in places)
    shared = in_left > 1 if same else (in_left > 0) & (in_right > 0)
    column, total = np.cumsum(shared) - 1, int(shared.sum())
    cells = []
    for where, size in zip(places, sizes, strict=True):
        row, use = np.repeat(np.arange(len(size)), size), shared[where]
        row, at = row[use], column[where[use]]
        order = np.argsort(at, kind="stable")
        cells.append((row[order], at[order]))
    common = np.zeros((len(left), len(right)), np.float32)
    width = max(256, min(8192, (1 << 22) // max(1, len(left))))
    for first in range(0, total, width):
        parts = []
        for (row, at), size in zip(cells[:1] if same else cells, sizes, strict=False):
            a, b = np.searchsorted(at, [first, first + width])
            part = np.zeros((len(size), min(width, total - first)), np.float32)
            part[row[a:b], at[a:b] - first] = 1
            parts.append(part)
        common += parts[0] @ parts[-1].T
    return common


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a matrix left x right. Exact: intersections are counted."""
    sizes = [np.array([len(s) for s in sets], float) for sets in (left, right)]
    near = common_counts(left, right).astype(float) * (1 + threshold) >= threshold * (sizes[0][:, None] + sizes[1][None, :]) - 1e-9
    if left is right:
        np.fill_diagonal(near, False)
    return near


def telling(size: int, threshold: float) -> int:
    """How many of its least shingles a set of this size has to show: two sets as near as the threshold share one of them."""
    return size - math.ceil(threshold * size - 1e-9) + 1


def linked(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Which pairs reach the threshold, as a symmetric matrix; with side, only pairs of different sides."""
    near = near_pairs(sets, sets, threshold)
    return near & (side[:, None] != side[None, :]) if side is not None else near


def _roots(near: np.ndarray) -> np.ndarray:
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _roots_across(near: np.ndarray) -> np.ndarray:
    """The same for links between two sides: places of the left rows, then those of the right."""
    m, n = near.shape
    label = np.arange(m + n)
    while True:
        left = np.minimum(label[:m], np.where(near, label[None, m:], m + n).min(axis=1, initial=m + n))
        right = np.minimum(label[m:], np.where(near, left[:, None], m + n).min(axis=0, initial=m + n))
        new = np.concatenate([left, right])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sorted_forest(classes: DataFrame, trees: int, label_values: int, floor: int) -> DataFrame:
    """Neighbours in the trees' sorted labels: a (the row before), c, `shared` (the values of their common prefix, floor at least), heads (the first
    row of the range of rows that share as many values as c, for floor, floor + 1, ... values) and range (which all rows of c's range of
    floor values have alike).

    Each task also has its first and last row; where ranges of two tasks touch, the driver (two rows for each task) links these.
    """
    width = 2 * label_values
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = classes.select("c", "labels", tree.alias("tree")).select(F.col("tree").cast("byte").alias("tree"), F.substring("labels", F.col("tree") * width + 1, width).alias("label"), "c")
    ranges = rows.repartitionByRange("tree", "label", "c").sortWithinPartitions("tree", "label", "c")
    names = ["a", "c", "heads", "shared", "tree", "label", "last"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths = np.arange(floor, label_values + 1)
        before = None  # of the row before: tree, values, class, and the heads of its ranges by depth
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            trees_, c = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            raw = b"".join(batch.column(1).to_pylist())
            values = np.frombuffer(raw, ">u2").reshape(n, label_values)
            if before is None:
                yield edge(batch, 0, np.full(len(depths), c[0]), False)
                before = (-1, values[0], -1, np.full(len(depths), -1, np.int64))
            t = np.concatenate([[before[0]], trees_])
            v = np.concatenate([before[1][None], values])
            same = (v[1:] == v[:-1]) & (t[1:] == t[:-1])[:, None]
            shared = np.cumprod(same, axis=1).sum(axis=1)
            at = np.maximum.accumulate(np.where(shared[:, None] < depths, np.arange(n)[:, None], -1), axis=0)
            heads = np.where(at >= 0, c[at], before[3][None])
            hit = np.flatnonzero(shared >= floor)
            previous = np.concatenate([[before[2]], c])[:-1]
            nothing = pa.nulls(len(hit), pa.binary()), pa.nulls(len(hit), pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * len(depths)), pa.array(heads[hit].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(previous[hit]), pa.array(c[hit]), lists, pa.array(shared[hit].astype(np.int32)), pa.array(trees_[hit]), *nothing], names)
            before = (trees_[-1], values[-1], c[-1], heads[-1])
            final = batch.slice(n - 1, 1)
        if before is not None:
            yield edge(final, 0, before[3], True)

    def edge(batch: pa.RecordBatch, at: int, heads: np.ndarray, last: bool) -> pa.RecordBatch:
        one = batch.slice(at, 1)
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), one.column(2), pa.array([heads.tolist()], pa.list_(pa.int64())), pa.nulls(1, pa.int32()), one.column(0), one.column(1), pa.array([last])], names)

    found = saved(ranges.mapInArrow(scan, "a long, c long, heads array<long>, shared int, tree byte, label binary, last boolean"), "forest")
    # two rows for each task, in the order of the tasks' ranges; the first of a task comes before its last
    ends = sorted(((r["tree"], bytes(r["label"]), r["c"], r["last"], r["heads"]) for r in found.filter("a IS NULL").select("tree", "label", "c", "last", "heads").collect()), key=lambda e: e[:4])
    inner = found.filter("a IS NOT NULL").select("a", "c", "shared", "heads", "tree", F.col("heads")[0].alias("range"))
    touching, range_of = [], {}
    for (t1, v1, c1, last1, heads1), (t2, v2, c2, last2, _) in zip(ends, ends[1:], strict=False):
        if last1 and not last2 and t1 == t2:
            x, y = (np.frombuffer(v, ">u2") for v in (v1, v2))
            if (shared := int(np.cumprod(x == y).sum())) >= floor:
                one = range_of.get((t1, heads1[0]), heads1[0])
                range_of[t1, c2] = one
                touching.append((c1, c2, shared, [h if d <= shared else c2 for d, h in enumerate(heads1, floor)], t1, one))
    if not touching:
        return inner
    spark = classes.sparkSession
    other = spark.createDataFrame([(t, c, one) for (t, c), one in range_of.items()], "tree byte, range long, _one long")  # a row for each task at most
    inner = inner.join(F.broadcast(other), ["tree", "range"], "left").withColumn("range", F.coalesce("_one", "range")).drop("_one")
    columns = ["a", "c", "shared", "heads", "tree", "range"]
    return inner.select(*columns).unionByName(spark.createDataFrame(touching, inner.select(*columns).schema))


def wanted_depths(neighbours: DataFrame, trees: int, label_values: int, floor: int, threshold: float, target_recall: float) -> DataFrame:
    """c and the depth of its prefixes, for each class with a neighbour: the longest at which the recall of its matches reaches the target.

    A pair that is next to each other in k trees has a similarity of (k / trees) ** (1 / floor) at least, as far as the signatures show;
    classes sorted in between only make that less.
    """
    pairs = neighbours.groupBy(F.least("a", "c").alias("u"), F.greatest("a", "c").alias("v")).agg(F.least(F.count(F.lit(1)), F.lit(trees)).alias("k"))
    similarity = F.greatest(F.lit(threshold), F.pow(F.col("k") / trees, F.lit(1 / floor)))
    both = pairs.select(F.explode(F.array("u", "v")).alias("c"), similarity.alias("s"))
    recall = {d: F.count(F.lit(1)) / F.sum(1 / (1 - F.pow(1 - F.pow("s", F.lit(float(d))), F.lit(float(trees))))) for d in range(floor + 1, label_values + 1)}
    sums = both.groupBy("c").agg(*(r.alias(f"r{d}") for d, r in recall.items()), F.count(F.lit(1)).alias("n"))
    reached = [F.when(F.col(f"r{d}") >= target_recall, F.lit(d)) for d in recall]
    return sums.select("c", F.coalesce(*reversed(reached), F.lit(floor)).alias("depth"))


def wanted_edges(neighbours: DataFrame, depths: DataFrame, floor: int) -> DataFrame:
    """Edges u, v that let each range hang together down to the shortest prefix that a class in it wants."""
    near = neighbours.join(depths.select("c", F.col("depth").alias("_d1")), "c").join(depths.select(F.col("c").alias("a"), F.col("depth").alias("_d2")), "a")
    near = saved(near.select(F.concat_ws(":", "tree", "range").alias("_range"), "c", "heads", F.least("_d1", "_d2").alias("_d")), "near")
    least = saved(near.groupBy("_range").agg(F.min("_d").alias("_depth"), F.count(F.lit(1)).alias("_n")), "ranges")  # all of a range are a or c in a row
    met = lookup(near.select("_range", "c", "heads"), least, "_range", "_n", "c")
    return met.select(F.col("c").alias("u"), F.element_at("heads", F.col("_depth") - floor + 1).alias("v")).filter("u <> v")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, threshold: float = 0.8, trees: int = 24, label_values: int = 10, target_recall: float = 0.995, block_classes: int = 128, widest_block: int = 2048, seed: int = 3) -> DataFrame:
    """A row for each row of docs: doc_id, h1 and h2 (its text's hash), class_id (smallest doc_id of all documents linked to it directly or by
    others), n_links (other rows that it links to, copies included), n_copies (rows with its text), first_h1 and first_h2 (the text that
    stands for the class; of several with the id class_id, that with the smallest hash).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    h1, h2 = text_keys(F.col("text"))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                labels = minhash_labels(Texts(batch.column("text")), n, trees * label_values, seed)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(labels, pa.binary())], ["doc_id", "h1", "h2", "labels"])

    table = saved(rows.mapInArrow(sketch, f"doc_id {id_type}, h1 long, h2 long, labels binary"), "signatures")
    classes = table.filter(F.col("labels").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"))
    classes = saved(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    floor = prefix_depth(threshold, trees, label_values, target_recall)
    neighbours = sorted_forest(classes, trees, label_values, floor)
    depths = saved(wanted_depths(neighbours, trees, label_values, floor, threshold, target_recall), "depths")
    groups = saved(components(wanted_edges(neighbours, depths, floor)).select(F.col("node").alias("c"), F.col("root").cast("string").alias("root")), "groups")

    sizes = saved(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = saved(lookup(groups, sizes, "root", "size", "c"), "members")

    own_id = F.xxhash64(never_null(F.col("doc_id")))
    of_text = members.join(classes.select("c", "h1", "h2", "first_id", "copies"), "c")
    of_text = of_text.select("c", "h1", "h2", "copies", (F.col("size") > block_classes).alias("large"), F.xxhash64(never_null(F.col("first_id"))).alias("own"))
    # members grow with the documents: never broadcast, however small they are here
    found = rows.withColumn("own", own_id).select("own", "h1", "h2", "text").join(of_text.hint("merge"), ["own", "h1", "h2"]).dropDuplicates(["own", "h1", "h2"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                t = Texts(batch.column("text"))
                h, doc = shingles(t, n)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, doc = h[new], doc[new]
                edge = np.searchsorted(doc, np.arange(t.n + 1))
                own = [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
                first = [one[: telling(len(one), threshold)].view(np.int64).tolist() if large else None for one, large in zip(own, batch.column("large").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("copies"), pa.array(first, pa.list_(pa.int64())), pa.array([one.tobytes() for one in own], pa.binary())], ["c", "copies", "first", "set"])

    with_sets = saved(found.select("c", "copies", "large", "text").mapInArrow(sets, "c long, copies long, first array<long>, set binary"), "sets")

    units = members.select("c", "root", F.lit(None).cast("long").alias("shingle"), "size")
    if not sizes.filter(F.col("size") > block_classes).isEmpty():
        in_shingles = members.filter(F.col("size") > block_classes).join(with_sets.select("c", "first").hint("merge"), "c").select("c", "root", "size", F.explode("first").alias("shingle"))
        shared_by = in_shingles.groupBy("root", "size", "shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        shared_by = saved(shared_by, "shared-shingles")
        apart = shared_by.groupBy("root", "size").agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1)).alias("pairs")).filter(F.col("pairs") * 2 < F.col("size").cast("double") * (F.col("size") - 1))
        apart = saved(apart.select("root", "size", F.lit(True).alias("apart")), "apart")
        if not apart.isEmpty():
            flagged = lambda rows: lookup(rows, apart.select("root", "apart", F.col("size").alias("_size")), "root", "_size", "c").drop("_size")
            both = F.concat_ws(":", "root", "shingle").alias("_both")
            each = lookup(flagged(in_shingles).filter("apart").select("c", "root", "shingle", both), shared_by.select(both, "m"), "_both", "m", "c")
            units = flagged(units).filter("apart IS NULL").drop("apart").unionByName(each.filter("m > 1").select("c", "root", "shingle", F.col("m").alias("size")))
    blocks = F.when(F.col("size") <= block_classes, 1).otherwise(F.greatest(F.least(F.ceil(F.col("size") / block_classes), F.lit(24)), F.ceil(F.col("size") / widest_block))).cast("int")
    units = units.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c", "root", "shingle"), F.col("blocks")).cast("int"))

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = units.join(with_sets.hint("merge"), "c").select("root", "shingle", "block", other, "c", "copies", "set")
    task = [F.col("root"), F.col("shingle"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    keys = ["root", "shingle", "i", "j"]
    tasks = tasks.select(*task, "c", "block", "copies", "set").repartitionByRange(*keys).sortWithinPartitions(*keys, "c")  # ranges of even size, no task cut

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def result() -> pa.RecordBatch:
            _, shingle, i, j = now
            sides = [held] if i == j else [[r for r in held if r[1] == k] for k in (i, j)]
            lists = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
            near = near_pairs(lists[0], lists[-1], threshold) if all(lists) else np.zeros((len(lists[0]), len(lists[-1])), bool)
            if shingle is not None and near.any():  # a pair counts in the first shingle that it shares
                at = np.uint64(shingle % 2**64)
                before = [[one[: np.searchsorted(one[: telling(len(one), threshold)], at)] for one in side] for side in lists]
                near &= common_counts(before[0], before[-1]) == 0
            c = np.array([r[0] for side in sides for r in side], np.int64)
            copies = [np.array([r[2] for r in side], np.int64) for side in sides]
            links = near @ copies[-1] if i == j else np.concatenate([near @ copies[1], copies[0] @ near])
            roots = _roots(near) if i == j else _roots_across(near)
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(c[roots]), pa.array(links)], ["u", "v", "links"])

        for batch in batches:
            for *task, c, block, copies, one in zip(*(batch.column(x).to_pylist() for x in (*keys, "c", "block", "copies", "set")), strict=True):
                if task != now:
                    if held:
                        yield result()
                    now, held = task, []
                held.append((c, block, copies, one))
        if held:
            yield result()

    compared = saved(tasks.mapInArrow(compare, "u long, v long, links long"), "links")
    linked_to = components(compared.select("u", "v")).select(F.col("node").alias("c"), "root")
    links = compared.groupBy(F.col("u").alias("c")).agg(F.sum("links").alias("links"))
    named = classes.select("c", "h1", "h2", "first_id", "copies").join(linked_to, "c", "left").join(links, "c", "left").withColumn("root", F.coalesce("root", "c").cast("string"))
    named = saved(named, "named")
    null_last = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "h1", "h2")
    heads = saved(named.groupBy("root").agg(F.min(null_last).alias("first"), F.count(F.lit(1)).alias("_n")), "heads")
    classed = lookup(named, heads, "root", "_n", "c").select(
        F.concat_ws(":", "h1", "h2").alias("_key"), F.col("first.first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"), F.col("first.h1").alias("first_h1"), F.col("first.h2").alias("first_h2"),
    )
    worded = F.col("labels").isNotNull()
    each = table.select("doc_id", "h1", "h2", worded.alias("_worded"), F.concat_ws(":", "h1", "h2").alias("_key"))
    out = lookup(each, classed, "_key", "n_copies", "doc_id")
    alone = lambda c, otherwise: F.when(F.col("_worded"), F.col(c)).otherwise(otherwise).alias(c)
    return out.select("doc_id", "h1", "h2", alone("class_id", F.col("doc_id")), alone("n_links", F.lit(0)), alone("n_copies", F.lit(1)), alone("first_h1", F.col("h1")), alone("first_h2", F.col("h2")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "class_id", "n_links", "n_copies")
