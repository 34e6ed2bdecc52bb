"""Causal graphs of lagged and contemporaneous links by constraint search: PCMCI+, and J-PCMCI+ over several panels with context.

All tests of a panel only need the correlation matrix of its stacked lags, which is summed over chunks of frames; so no task meets a whole recording.
The search then goes level by level. Each level tests all (panel, block of targets) pairs as tasks of their own against the skeleton that the level
before left, whose changes are applied together at its end, so results depend on no order; every level's links are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import pcmci
from ..scratch import forget, written
from .bss import _types
from .lagged import CHUNK, REC, square, stacked_correlations

_LINK = "source int, lag int, target int, strength double"
_TESTED = "source int, lag int, target int, r double, p double, strength double, given array<int>"


def _each(df: DataFrame, work: Callable[[dict], pd.DataFrame], schema: str, keys: Sequence[str]) -> DataFrame:
    """Rows of work(row) with the row's keys before them; rows of one panel at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own in batch.to_dict("records"):
                if not len(found := work(own)):
                    continue
                yield pd.DataFrame({k: [own[k]] * len(found) for k in keys} | {c: found[c] for c in found.columns})

    return df.mapInPandas(run, f"{_types(df, keys)}, {schema}")


def _links(own: dict) -> pcmci.Links:
    out = pcmci.Links({}, {}, {})
    for p in sorted(own["parents"] if own["parents"] is not None else [], key=lambda p: (-p["strength"], p["source"], p["lag"])):
        out.parents.setdefault(p["target"], []).append((p["source"], p["lag"]))
    for link in own["links"] if own["links"] is not None else []:
        if link["lag"]:
            out.lagged.setdefault(link["target"], {})[link["source"], link["lag"]] = link["strength"]
        else:
            out.now.setdefault(link["target"], {})[link["source"]] = link["strength"]
    return out


@dataclass(frozen=True)
class _Nodes:
    """What tasks have to know: columns and kind of each node (None: each series is one of the system), levels, and targets of a block."""

    tau_max: int
    alpha: float
    columns: Sequence[Sequence[int]] | None = None
    kinds: Sequence[str] = ()
    block: int = 8

    def tests(self, own: dict) -> pcmci.Tests:
        columns = self.columns if self.columns is not None else [[a] for a in range(own["series"])]
        return pcmci.Tests(square(own["matrix"]), int(own["n"]), int(own["series"]), columns, self.kinds)

    def targets(self, own: dict, test: pcmci.Tests) -> list[int]:
        return test.system[own["_at"] : own["_at"] + self.block]


class _Search:
    """Skeleton searches over all panels: matrices(keys, series, n, matrix) and the nodes in them."""

    def __init__(self, matrices: DataFrame, keys: Sequence[str], nodes: _Nodes):
        self.matrices, self.keys, self.nodes = matrices, list(keys), nodes

    def in_blocks(self, rows: DataFrame) -> DataFrame:
        """Each panel once for each block of `block` targets."""
        n = F.lit(sum(k == "system" for k in self.nodes.kinds)) if self.nodes.kinds else F.col("series")
        return rows.withColumn("_at", F.explode(F.sequence(F.lit(0), n - 1, F.lit(self.nodes.block)))).repartition(*self.keys, "_at")

    def parents(self, sources: Sequence[str], given: DataFrame | None) -> DataFrame:
        """Lagged parents of every system node among nodes of the kinds `sources`; given(parents): context that is always conditioned on."""
        rows, nodes, has_context = self.matrices if given is None else self.matrices.join(given, self.keys, "left"), self.nodes, given is not None

        def find(own: dict) -> pd.DataFrame:
            test, out = nodes.tests(own), []
            always = own["context"] if has_context else None
            for j in nodes.targets(own, test):
                fixed = [(c["source"], c["lag"]) for c in (always if always is not None else []) if c["target"] == j]
                among = [a for a in range(len(test.columns)) if test.kind(a) in sources]
                out += [(a, k, j, s) for (a, k), s in pcmci.lagged_parents(test, j, among, nodes.tau_max, nodes.alpha, fixed)]
            return pd.DataFrame(out, columns=["source", "lag", "target", "strength"])

        return _each(self.in_blocks(rows), find, _LINK, self.keys)

    def contemporaneous(self, sources: Sequence[str]) -> DataFrame:
        """All pairs of a node of the kinds `sources` and another system node in the same frame."""
        nodes = self.nodes

        def pairs(own: dict) -> pd.DataFrame:
            test = nodes.tests(own)
            return pd.DataFrame([(a, 0, j, float("inf")) for j in test.system for a in range(len(test.columns)) if a != j and test.kind(a) in sources], columns=["source", "lag", "target", "strength"])

        return _each(self.matrices, pairs, _LINK, self.keys)

    def skeleton(self, links: DataFrame, parents: DataFrame, tested_kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """links that no momentary test separates, with r and p of their last test, and the links removed with their separating sets.

        parents: fixed conditions. Only links from nodes of tested_kinds are tested; others stay as they are.
        """
        spark, keys, nodes, on = links.sparkSession, self.keys, self.nodes, [*self.keys, "source", "lag", "target"]
        pack = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct("source", "lag", "target", "strength")).alias(name))
        fixed, _ = written(pack(parents, "parents"), "parents")
        now, path = written(links.withColumns({"r": F.lit(None).cast("double"), "p": F.lit(None).cast("double")}), "links")
        removed, level = None, 0
        while True:

            def test_level(own: dict, level: int = level) -> pd.DataFrame:
                test, held, out = nodes.tests(own), _links(own), []
                for j in nodes.targets(own, test):
                    out += [(*place, j, r, p, abs(r), given) for place, r, p, given in pcmci.level_tests(test, held, j, level, nodes.alpha) if test.kind(place[0]) in tested_kinds]
                return pd.DataFrame(out, columns=["source", "lag", "target", "r", "p", "strength", "given"])

            state = self.matrices.join(pack(now, "links"), keys).join(fixed, keys, "left")
            tested, _ = written(_each(self.in_blocks(state), test_level, _TESTED, keys), "tests")
            if tested.isEmpty():
                break
            gone = tested.filter("given IS NOT NULL").select(*on, "r", "p", "given")
            removed = gone if removed is None else removed.unionByName(gone)
            # a contemporaneous link goes both ways
            both = gone.select(*on).unionByName(gone.filter("lag = 0").select(*keys, F.col("target").alias("source"), "lag", F.col("source").alias("target"))).distinct()
            fresh = tested.select(*on, F.col("r").alias("_r"), F.col("p").alias("_p"), F.col("strength").alias("_s"))
            kept = now.join(both, on, "left_anti").join(fresh, on, "left")
            kept = kept.select(*on, F.least("strength", "_s").alias("strength"), F.coalesce("_r", "r").alias("r"), F.coalesce("_p", "p").alias("p"))
            before = path
            now, path = written(kept, "links")
            forget(spark, before)
            level += 1
        if removed is None:
            removed = now.limit(0).select(*on, "r", "p", F.lit(None).cast("array<int>").alias("given"))
        return now, removed


def _graph(search: _Search, links: DataFrame, parents: DataFrame, removed: DataFrame, rule: str) -> DataFrame:
    """keys, source, lag, target, mark, r and p. Lagged links and those from context point at their target; contemporaneous ones are oriented."""
    keys, nodes = search.keys, search.nodes
    pack = lambda df, name, *more: df.groupBy(*keys).agg(F.collect_list(F.struct("source", "lag", "target", *more)).alias(name))
    state = search.matrices.join(pack(links, "links", "strength", "r", "p"), keys).join(pack(parents, "parents", "strength"), keys, "left").join(pack(removed, "removed", "given"), keys, "left")

    def orient(own: dict) -> pd.DataFrame:
        test, held = nodes.tests(own), _links(own)
        separated = {((r["source"], r["lag"]), r["target"]): list(r["given"]) for r in (own["removed"] if own["removed"] is not None else [])}
        marks = pcmci.oriented(test, held, separated, nodes.alpha, rule)
        out = [(k["source"], k["lag"], k["target"], "-->" if k["lag"] else marks.get((k["source"], k["target"]), "-->"), k["r"], k["p"]) for k in own["links"]]
        return pd.DataFrame(out, columns=["source", "lag", "target", "mark", "r", "p"])

    return _each(state, orient, "source int, lag int, target int, mark string, r double, p double", keys)


def pcmci_plus(wide: DataFrame, tau_max: int, alpha: float = 0.01, rule: str = "majority", keys: Sequence[str] = REC, chunk: int = CHUNK, block: int = 8) -> DataFrame:
    """Links of every panel: keys, source, lag, target, mark, r and p.

    mark is '-->' for lagged and directed contemporaneous links, with a '<--' row the other way for the latter; 'o-o' where no rule gives a direction and
    'x-x' where rules contradict, both ways. r and p are the partial correlation of the last momentary test that didn't separate and its analytic p.
    Frames count that have 2 * tau_max frames before them without a gap. A panel without such frames has no links; constant series have none.
    """
    if tau_max < 1:
        raise ValueError("tau_max must be 1 or more")
    matrices, _ = written(stacked_correlations(wide, 2 * tau_max, keys, chunk=chunk), "correlations")
    search = _Search(matrices, keys, _Nodes(tau_max, alpha, block=block))
    parents, _ = written(search.parents(("system",), None), "parents")
    links, removed = search.skeleton(parents.unionByName(search.contemporaneous(("system",))), parents, ("system",))
    return _graph(search, links, parents, removed, rule)


def jpcmci_plus(
    wide: DataFrame, tau_max: int, alpha: float = 0.01, pool: Sequence[str] = (), panel: str = "recording", context: DataFrame | None = None, space_context: DataFrame | None = None,
    space_dummy: bool = True, time_block: int | None = None, most_levels: int = 64, rule: str = "majority", chunk: int = CHUNK, block: int = 8,
) -> DataFrame:
    """One graph for the panels of each pool, whose dynamics are the same but for context: pool keys, source, lag, target, mark, r and p.

    context(panel and pool keys, time_index, c: array): series that influence the system and aren't influenced by it; space_context(panel and pool keys,
    c: array): constants of a panel. What context isn't observed is stood in for by dummies: which panel a frame is of, and with time_block which
    block of so many frames, each one node of one column for each level but the first. Pools have most_levels panels or blocks at most, else an error.

    1. Lagged and contemporaneous links from observed context into the system are found with the system's own links. 2. Each dummy is tested given what
    step 1 found, all its columns at once (F test). 3. The system's links are found anew, given the context and dummies of both ends. Nodes are numbered: the system's series, context,
    space context, space dummy, time dummy; all links from context and dummies point at the system.
    """
    if tau_max < 1:
        raise ValueError("tau_max must be 1 or more")
    spark, pool = wide.sparkSession, list(pool)
    rows = wide
    if not pool:
        rows, pool = rows.withColumn("pool", F.lit(0)), ["pool"]
        context, space_context = (c.withColumn("pool", F.lit(0)) if c is not None else None for c in (context, space_context))
    sizes, kinds = [], []
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], f"{_types(rows, pool)}, source int, lag int, target int, mark string, r double, p double")
    sizes += [1] * first["n"]
    kinds += ["system"] * first["n"]
    for given, kind, on in ((context, "context", [*pool, panel, "time_index"]), (space_context, "space", [*pool, panel])):
        if given is not None:
            width = given.select(F.size("c").alias("n")).first()["n"]
            sizes, kinds = sizes + [1] * width, kinds + [kind] * width
            rows = rows.join(given.select(*on, "c"), on).withColumn("x", F.concat("x", F.transform("c", lambda v: v.cast("double")))).drop("c")
    for wanted, level in ((space_dummy, F.col(panel).cast("string")), (time_block is not None, F.floor(F.col("time_index") / F.lit(time_block or 1)).cast("string"))):
        if not wanted:
            continue
        seen = sorted({r[0] for r in rows.select(level).distinct().limit(most_levels * 16 + 1).collect()})
        most = rows.select(*pool, level.alias("_l")).groupBy(*pool).agg(F.count_distinct("_l").alias("n")).agg(F.max("n")).first()[0]
        if most > most_levels or len(seen) > most_levels * 16:
            raise ValueError(f"a dummy of more than {most_levels} levels")
        if len(seen) < 2:
            continue
        rows = rows.withColumn("x", F.concat("x", F.array(*((level == s).cast("double") for s in seen[1:]))))
        sizes.append(len(seen) - 1)
        kinds.append("dummy")
    edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    columns = [list(range(a, b)) for a, b in zip(edge, edge[1:], strict=False)]
    matrices, _ = written(stacked_correlations(rows, 2 * tau_max, [*pool, panel], pool, chunk), "correlations")
    search = _Search(matrices, pool, _Nodes(tau_max, alpha, columns, kinds, block))
    named = F.create_map(*(F.lit(v) for a, k in enumerate(kinds) for v in (a, k)))
    kind = named[F.col("source")]

    parents, _ = written(search.parents(("system", "context"), None), "parents")
    start = parents.unionByName(search.contemporaneous(("system", "context", "space")))
    found, _ = search.skeleton(start, parents, ("system", "context", "space"))
    outer = found.filter(kind != "system")
    if "dummy" in kinds:
        fixed = found.filter("lag > 0").unionByName(found.filter(kind == "space")).select(*pool, "source", "lag", "target", "strength")
        dummies = found.drop("r", "p").unionByName(search.contemporaneous(("dummy",)))
        tested, _ = search.skeleton(dummies, fixed, ("dummy",))
        outer = outer.unionByName(tested.filter(kind == "dummy"))
    outer, _ = written(outer, "context-links")

    given = outer.groupBy(*pool).agg(F.collect_list(F.struct("source", "lag", "target")).alias("context"))
    inner, _ = written(search.parents(("system",), given), "parents")
    conditions = inner.unionByName(outer.select(*pool, "source", "lag", "target", "strength"))
    links, removed = search.skeleton(inner.unionByName(search.contemporaneous(("system",))), conditions, ("system",))
    return _graph(search, links.unionByName(outer), conditions, removed, rule)


def low_order_tests(wide: DataFrame, tau_max: int, keys: Sequence[str] = REC, chunk: int = CHUNK, block: int = 8) -> DataFrame:
    """Every test of the first two levels over all places, without a search: keys, source, lag, target, given_source and given_lag (NULL at level 0),
    r and p. What a search would see before it removes anything.
    """
    matrices, _ = written(stacked_correlations(wide, tau_max, keys, chunk=chunk), "correlations")
    search = _Search(matrices, keys, _Nodes(tau_max, 0.0, block=block))
    nodes = search.nodes

    def run(own: dict) -> pd.DataFrame:
        test, out = nodes.tests(own), []
        places = [(a, k) for a in test.system for k in range(tau_max + 1)]
        for j in nodes.targets(own, test):
            for place in places:
                if place != (j, 0):
                    out += [(*place, j, *(given or (None, None)), *test(place, (j, 0), [given] if given else [])) for given in [None, *(g for g in places if g not in (place, (j, 0)))]]
        found = pd.DataFrame(out, columns=["source", "lag", "target", "given_source", "given_lag", "r", "p"])
        return found.astype({"given_source": "Int32", "given_lag": "Int32"})

    return _each(search.in_blocks(matrices), run, "source int, lag int, target int, given_source int, given_lag int, r double, p double", list(keys))
