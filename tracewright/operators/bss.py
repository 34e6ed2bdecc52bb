"""Decomposition of each recording by grouped numpy fits that emit parameters; transforms, reconstruction, ranking and selection in SQL.

models(keys, method, component, unmixing, mixing, mean) hold one row for each component, so a fit's output is small whatever the recording's
length. Training rows are chosen by the caller below the fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_divide
from ..kernels import bss, models, spectral

REC = ("recording",)
_VECTOR = "array<double>"


@dataclass(frozen=True)
class FitSpec:
    method: str
    components: int | None = None
    variance: float | None = None

    @property
    def name(self) -> str:
        more = f"/components{self.components}" if self.components else f"/pca_var{self.variance:g}" if self.variance else ""
        return self.method + more


def fit_specs(methods: Sequence[str], counts: Sequence[int | None] = (None,), variances: Sequence[float] = ()) -> list[FitSpec]:
    return list(dict.fromkeys([FitSpec(m, c) for m in methods for c in counts] + [FitSpec(m, None, v) for m in methods for v in variances]))


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _nothing(columns: Iterable[str]) -> pd.DataFrame:
    """No rows, in columns that convert to any type."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _names(schema: str) -> list[str]:
    """The columns of a schema of simple types."""
    return [c.split()[0].strip("`") for c in schema.split(", ")]


#: The methods that a PCA rank or share of variance reduces.
REDUCED = ("sobi", "jade")


def _axes(x: np.ndarray) -> int:
    """Axes that frames vary along, but for rounding: one less than there are different frames at most."""
    return int(np.linalg.matrix_rank(x - x.mean(axis=0), tol=max(x.shape) * np.finfo(float).eps * np.linalg.norm(x)))


def _resolved(x: np.ndarray, limit: int, spec: FitSpec, pca_components: int | None, pca_variance: float | None) -> int:
    """How many components a fit has, `limit` at most: the spec's own, and for the methods of REDUCED no more than the PCA rank or than the share asks for."""
    if spec.variance:
        return max(1, min(limit, models.rank_for_energy(x, spec.variance)))
    limit = min(limit, spec.components or limit)
    if spec.method in REDUCED and pca_components:
        return min(limit, pca_components)
    if spec.method in REDUCED and pca_variance:
        return max(1, min(limit, models.rank_for_energy(x, pca_variance)))
    return limit


def fit_bss(train: DataFrame, specs: Sequence[FitSpec], keys: Sequence[str] = REC, tol: float = 1e-4, rounds: int = 500, seed: int = 0, lags: Sequence[int] = (1, 2, 3, 5), cumulants: int = 200, pca_components: int | None = None, pca_variance: float | None = None) -> DataFrame:
    """Models of wide frames (keys, time_index, x) for each spec; a contiguous run of frames is a segment. One frame alone, or equal ones, have no model."""
    by_name = {s.name: s for s in specs}
    jobs = train.select(*keys, "time_index", "x").withColumn("spec", F.explode(F.array(*map(F.lit, by_name))))
    # a fit is much work on few bytes, so its partitions must not be put together by their size
    jobs = jobs.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "spec")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("time_index", kind="stable")
        x, t = np.stack(own["x"].to_list()), own["time_index"].to_numpy()
        spec = by_name[own["spec"].iloc[0]]
        segments = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(t) != 1) + 1, [len(t)]]))
        if not (limit := _axes(x)):
            return _nothing(_names(schema))
        d = bss.decompose(x, _resolved(x, limit, spec, pca_components, pca_variance), spec.method, tol, rounds, seed, lags, segments, cumulants)
        k = d.mixing.shape[1]
        out = {c: [own[c].iloc[0]] * k for c in keys} | {"spec": spec.name, "method": spec.method, "component": np.arange(k), "unmixing": list(d.unmixing), "mixing": list(d.mixing.T), "mean": [d.mean] * k}
        return pd.DataFrame(out | {"energy": (d.sources**2).mean(axis=0), "rounds": d.rounds, "converged": d.converged})

    schema = f"{_types(train, keys)}, spec string, method string, component int, unmixing {_VECTOR}, mixing {_VECTOR}, mean {_VECTOR}, energy double, rounds int, converged boolean"
    return jobs.groupBy(*keys, "spec").applyInPandas(fit, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def transform(wide: DataFrame, fitted: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Frozen unmixing of any frames: components(keys, spec, component, time_index, value)."""
    met = wide.join(fitted.select(*keys, "spec", "component", "unmixing", "mean"), list(keys))
    return met.select(*keys, "spec", "component", "time_index", _dot(F.zip_with("x", "mean", lambda x, m: x - m), F.col("unmixing")).alias("value"))


def reconstruct(components: DataFrame, mixing: DataFrame, means: DataFrame, on: Sequence[str] = ("recording",)) -> DataFrame:
    """traces(on, time_index, neuron, value) from long components(component, time_index, value), mixing(neuron, component, weight) and
    means(neuron, mean). Only components in mixing count: filter it to keep or to reject some.
    """
    parts = components.join(mixing, [*on, "component"]).groupBy(*on, "time_index", "neuron").agg(F.sum(F.col("value") * F.col("weight")).alias("_v"))
    return parts.join(means, [*on, "neuron"]).select(*on, "time_index", "neuron", (F.col("_v") + F.col("mean")).alias("value"))


def mixing_long(fitted: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    return fitted.select(*keys, "spec", "component", F.posexplode("mixing").alias("neuron", "weight"))


def means_long(fitted: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    return fitted.filter("component = 0").select(*keys, "spec", F.posexplode("mean").alias("neuron", "mean"))


def welch_spectra(series: DataFrame, rate: float, nperseg: int = 250, noverlap: int = 125, keys: Sequence[str] = ("recording", "component"), time: str = "time_index", value: str = "value") -> DataFrame:
    """power (one-sided density) and frequency of each series; runs of consecutive times are segments. Series without two consecutive times have none."""

    def spectrum(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(time, kind="stable")
        t, x = own[time].to_numpy(), own[value].to_numpy(float)
        segments = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(t) != 1) + 1, [len(t)]]))
        if segments.max() < 2:
            return _nothing([*keys, "frequency", "power"])
        f, p = spectral.segmented_welch(x, segments, rate, nperseg, noverlap)
        return pd.DataFrame({k: [own[k].iloc[0]] for k in keys} | {"frequency": [f], "power": [p]})

    return series.select(*keys, time, value).groupBy(*keys).applyInPandas(spectrum, f"{_types(series, keys)}, frequency {_VECTOR}, power {_VECTOR}")


def panel_spectra(wide: DataFrame, rate: float, nperseg: int = 64, noverlap: int = 32, keys: Sequence[str] = ("recording", "variant"), time: str = "time_index") -> DataFrame:
    """power of each neuron of wide(keys, time, x), one matrix at a time; runs of consecutive times are segments. Panels without two consecutive times have none."""

    def spectra(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(time, kind="stable")
        t, x = own[time].to_numpy(), np.stack(own["x"].to_list()).astype(float)
        segments = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(t) != 1) + 1, [len(t)]]))
        if segments.max() < 2:
            return _nothing([*keys, "neuron", "power"])
        _, p = spectral.segmented_welch(x, segments, rate, nperseg, noverlap)
        return pd.DataFrame({k: [own[k].iloc[0]] * x.shape[1] for k in keys} | {"neuron": range(x.shape[1]), "power": list(p.T)})

    return wide.select(*keys, time, "x").groupBy(*keys).applyInPandas(spectra, f"{_types(wide, keys)}, neuron int, power {_VECTOR}")


def rank_clusters(spectra: DataFrame, rate: float, fmin: float, fmax: float, aggregate: str = "mean", keys: Sequence[str] = REC) -> DataFrame:
    """Clusters of spectra(keys, component, cluster, power) by the log of their mean power in a band: its mean, sum or peak. Highest first."""
    if aggregate not in ("mean", "sum", "peak"):
        raise ValueError(f"unknown aggregate {aggregate!r}")
    bins = spectra.select(*keys, "component", "cluster", (F.size("power") - 1).alias("_last"), F.posexplode("power").alias("_bin", "_p"))
    bins = bins.withColumn("_f", F.col("_bin") * (rate / 2) / F.col("_last")).filter(F.col("_f").between(max(0.0, fmin), min(fmax, rate / 2)))
    mean_log = bins.groupBy(*keys, "cluster", "_bin").agg(F.ln(F.greatest(F.avg("_p"), F.lit(2.220446049250313e-16))).alias("_l"))
    how = {"mean": F.avg("_l"), "sum": F.sum("_l"), "peak": F.max("_l")}[aggregate]
    sizes = spectra.groupBy(*keys, "cluster").agg(F.countDistinct("component").alias("n_components"))
    scored = mean_log.groupBy(*keys, "cluster").agg(how.alias("score")).join(sizes, [*keys, "cluster"])
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "cluster")).cast("int"))


def _features(own: pd.DataFrame, transform_name: str, start_bin: int) -> np.ndarray:
    x = np.stack(own["power"].to_list())
    x = x[:, min(max(start_bin, 0), x.shape[1] - 1) :]
    if transform_name == "log1p":
        return np.log1p(x)
    if transform_name == "normalized":
        total = x.sum(axis=1, keepdims=True)
        return x / np.where(total > 0, total, 1)
    return x


def _known_transform(name: str) -> None:
    if name not in ("raw", "log1p", "normalized"):
        raise ValueError(f"unknown transform {name!r}")


def cluster_components(spectra: DataFrame, n_clusters: int, transform_name: str = "log1p", start_bin: int = 0, seed: int = 0, keys: Sequence[str] = REC) -> DataFrame:
    """spectra with a k-means cluster of each component of a recording, over its transformed power."""
    _known_transform(transform_name)

    def label(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("component", kind="stable")
        x = _features(own, transform_name, start_bin)
        return own.assign(cluster=spectral.kmeans(x, min(n_clusters, len(x)), seed).astype(np.int32))

    columns = [c for c in spectra.columns if c != "cluster"]
    return spectra.select(*columns).groupBy(*keys).applyInPandas(label, f"{_types(spectra, columns)}, cluster int")


def cluster_sweep(spectra: DataFrame, counts: Sequence[int], transforms: Sequence[str], seeds: Sequence[int], start_bin: int = 0, keys: Sequence[str] = REC) -> DataFrame:
    """clusters(keys, labeling, feature_transform, n_clusters, seed, component, cluster, power) of every configuration; spectra are shuffled once."""
    for name in transforms:
        _known_transform(name)

    def label(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("component", kind="stable")
        parts = []
        for name in transforms:
            x = _features(own, name, start_bin)
            for k in counts:
                for seed in seeds:
                    cluster = spectral.kmeans(x, min(k, len(x)), seed).astype(np.int32)
                    parts.append(own.assign(labeling=f"{name}/k{k}/seed{seed}", feature_transform=name, n_clusters=k, seed=seed, cluster=cluster))
        return pd.concat(parts)

    columns = [*keys, "component", "power"]
    schema = f"{_types(spectra, columns)}, labeling string, feature_transform string, n_clusters int, seed int, cluster int"
    return spectra.select(*columns).groupBy(*keys).applyInPandas(label, schema)


@dataclass(frozen=True)
class Selection:
    strategy: str
    keep: int | None = None
    seed: int = 0

    def __post_init__(self):
        if self.strategy not in ("all", "low_frequency", "high_frequency", "random", "energy_matched_random"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.keep is None and self.strategy != "all":
            raise ValueError(f"{self.strategy} needs the number of clusters to keep")

    @property
    def name(self) -> str:
        count = "all" if self.strategy == "all" else f"k{self.keep}"
        return "/".join([self.strategy, count, *([f"seed{self.seed}"] if "random" in self.strategy else [])])


def _each(selections: Sequence[Selection]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(s.name).alias("name"), F.lit(s.strategy).alias("strategy"), F.lit(s.keep).cast("int").alias("keep"), F.lit(s.seed).alias("seed")) for s in selections))).alias("_s")


def select_all(ranked: DataFrame, components: DataFrame, selections: Sequence[Selection], keys: Sequence[str] = REC) -> DataFrame:
    """components(keys, component, cluster, energy) with the name of every selection that keeps them: all, the `keep` lowest- or
    highest-frequency clusters, random clusters, or random components until they hold the energy of the lowest-frequency ones. Random order is
    a seeded hash.
    """
    columns, parts = components.columns, []
    if whole := [s for s in selections if s.strategy == "all"]:
        parts.append(components.select(*columns, _each(whole)))
    if by_cluster := [s for s in selections if s.strategy != "all"]:
        asked = ranked.select(*keys, "cluster", "rank", _each(by_cluster))
        place = F.when(F.col("_s.strategy") == "high_frequency", -F.col("rank").cast("long")).when(F.col("_s.strategy") == "random", F.xxhash64("cluster", "_s.seed")).otherwise(F.col("rank").cast("long"))
        order = Window.partitionBy(*keys, "_s.name").orderBy(place, "cluster")
        kept = asked.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.greatest(F.lit(1), "_s.keep")).select(*keys, "cluster", "_s")
        chosen = components.join(kept, [*keys, "cluster"])
        parts.append(chosen.filter("_s.strategy <> 'energy_matched_random'").select(*columns, "_s"))
    if matched := [s for s in selections if s.strategy == "energy_matched_random"]:
        target = chosen.filter("_s.strategy = 'energy_matched_random'").groupBy(*keys, "_s.name").agg(F.sum("energy").alias("_target"))
        drawn = components.select(*columns, _each(matched))
        order = Window.partitionBy(*keys, "_s.name").orderBy(F.xxhash64("component", "_s.seed"), "component")
        run = F.coalesce(F.sum("energy").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        drawn = drawn.withColumn("_before", run).withColumn("name", F.col("_s.name")).join(target, [*keys, "name"])
        parts.append(drawn.filter(F.col("_before") < F.col("_target")).select(*columns, "_s"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*columns, F.col("_s.name").alias("name"))


def select_components(ranked: DataFrame, components: DataFrame, strategy: str, keep: int | None = None, seed: int = 0, keys: Sequence[str] = REC) -> DataFrame:
    """The components that one selection of select_all keeps."""
    return select_all(ranked, components, [Selection(strategy, keep, seed)], keys).drop("name")


def rebuilt(frames: DataFrame, fitted: DataFrame, kept: DataFrame, keys: Sequence[str] = ("recording", "fold"), chunk: int = 512) -> DataFrame:
    """Wide variants spec/name of frames(keys, time_index, role, x) for each name of kept(keys, spec, component, name): what those components of
    the frozen model alone give back. A task takes `chunk` frames, and each variant of them is one product of matrices; names that keep
    nothing have no rows.
    """
    names = kept.groupBy(*keys, "spec", "component").agg(F.sort_array(F.collect_set("name")).alias("names"))
    rows = frames.select(*keys, "time_index", "role", "x", F.floor(F.col("time_index") / chunk).cast("int").alias("part"))
    model = fitted.join(names, [*keys, "spec", "component"]).select(*keys, "spec", "component", "unmixing", "mixing", "mean", "names")
    model = model.join(rows.select(*keys, "part").distinct(), list(keys))
    model = model.toDF(*model.columns)  # columns of its own, as both sides come from frames
    of_spec = rows.join(fitted.select(*keys, "spec").distinct(), list(keys))

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if own.empty or model.empty:
            return own.assign(variant=[]).iloc[:0][[*keys, "variant", "time_index", "role", "x"]]
        z = (np.stack(own["x"].to_list()) - model["mean"].iloc[0]) @ np.stack(model["unmixing"].to_list()).T
        mixing, spec, parts = np.stack(model["mixing"].to_list()), model["spec"].iloc[0], []
        for name in sorted({n for some in model["names"] for n in some}):
            of_name = np.array([name in some for some in model["names"]])
            parts.append(own[[*keys, "time_index", "role"]].assign(variant=f"{spec}/{name}", x=list(z[:, of_name] @ mixing[of_name] + model["mean"].iloc[0])))
        return pd.concat(parts)

    group = [*keys, "spec", "part"]
    schema = f"{_types(frames, keys)}, variant string, time_index int, role string, x {_VECTOR}"
    return of_spec.groupBy(*group).cogroup(model.groupBy(*group)).applyInPandas(run, schema)


def energy_shares(fitted: DataFrame, kept: DataFrame, train: DataFrame, keys: Sequence[str] = ("recording", "fold")) -> DataFrame:
    """The share of the training energy that each variant of kept(keys, spec, component, name) gives back. A model's sources are uncorrelated
    with unit variance on its training frames, so that is the squared length of its components' mixing over the frames' total variance.
    """
    spread = train.select(*keys, F.posexplode("x").alias("neuron", "value")).groupBy(*keys, "neuron").agg(F.var_samp("value").alias("_v"))
    total = spread.groupBy(*keys).agg(F.sum("_v").alias("_total"))
    own = fitted.select(*keys, "spec", "component", F.aggregate("mixing", F.lit(0.0), lambda s, v: s + v * v).alias("_e"))
    sums = kept.join(own, [*keys, "spec", "component"]).groupBy(*keys, F.concat_ws("/", "spec", "name").alias("source")).agg(F.sum("_e").alias("_e"))
    return sums.join(total, list(keys)).select(*keys, "source", safe_divide("_e", "_total").alias("share")).filter(F.col("share").isNotNull())


def matched_pca(frames: DataFrame, shares: DataFrame, keys: Sequence[str] = ("recording", "fold")) -> DataFrame:
    """PCA of the fewest leading axes that hold each share(keys, source, share) of the training energy, as variants pca_energy_match/rank<r> of
    wide frames with a role. The first row of a variant names its sources, their shares and the share that it holds; others have NULL there.
    """

    def run(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "time_index", "role", "x", "variant", "sources", "shares", "matched_share"]
        if own.empty or wanted.empty:
            return _nothing(columns)
        own = own.sort_values("time_index", kind="stable")
        x, train = np.stack(own["x"].to_list()), (own["role"] == "train").to_numpy()
        mean, variance, axes = bss.principal_axes(x[train])
        run_share = np.cumsum(variance) / variance.sum()
        wanted = wanted.sort_values("source")
        rank = np.minimum(np.searchsorted(run_share, np.clip(wanted["share"], 0, 1) - 1e-12) + 1, len(variance))
        parts = []
        for r in sorted(set(rank)):
            part = own[[*keys, "time_index", "role"]].assign(x=list((x - mean) @ axes[:r].T @ axes[:r] + mean), variant=f"pca_energy_match/rank{r}")
            rest, of_rank = [None] * (len(part) - 1), wanted[rank == r]
            parts.append(part.assign(sources=[of_rank["source"].to_list(), *rest], shares=[of_rank["share"].to_list(), *rest], matched_share=[float(run_share[r - 1]), *rest]))
        return pd.concat(parts)[columns]

    schema = f"{_types(frames, keys)}, time_index int, role string, x {_VECTOR}, variant string, sources array<string>, shares {_VECTOR}, matched_share double"
    return frames.select(*keys, "time_index", "role", "x").groupBy(*keys).cogroup(shares.toDF(*shares.columns).groupBy(*keys)).applyInPandas(run, schema)


def gram(wide: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Sums of products of every pair of coordinates, pre-aggregated on the map side: what PCA and ridge need of any number of rows."""
    pairs = wide.select(*keys, F.posexplode("x").alias("i", "_a"), F.col("x").alias("_x")).select(*keys, "i", "_a", F.posexplode("_x").alias("j", "_b"))
    return pairs.filter("j >= i").groupBy(*keys, "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("product"), F.sum("_a").alias("sum_i"), F.sum("_b").alias("sum_j"), F.count(F.lit(1)).alias("n"))


def explained_variance(wide: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Share of variance of each principal axis, from the Gram sums; rank 1 is the largest."""

    def shares(own: pd.DataFrame) -> pd.DataFrame:
        d = int(own["j"].max()) + 1
        c = np.zeros((d, d))
        i, j, n = own["i"].to_numpy(), own["j"].to_numpy(), own["n"].to_numpy(float)
        c[i, j] = c[j, i] = own["product"].to_numpy() - own["sum_i"].to_numpy() * own["sum_j"].to_numpy() / n
        v = np.maximum(np.linalg.eigvalsh(c)[::-1], 0)
        return pd.DataFrame({k: [own[k].iloc[0]] * d for k in keys} | {"rank": np.arange(1, d + 1), "ratio": v / max(v.sum(), 1e-300)})

    g = gram(wide, keys)
    return g.groupBy(*keys).applyInPandas(shares, f"{_types(g, keys)}, rank int, ratio double")


def project_by_fold(frames: DataFrame, kinds: Sequence[tuple[str, int, int]], keys: Sequence[str] = ("recording", "fold")) -> DataFrame:
    """Baselines of wide frames with a role: (kind, rank, seed) with kind pca, random_subspace, factor_analysis, sparse_pca or nmf, each fitted
    on the rows of role train and applied to all; variant, time_index, x.
    """
    by_name = {f"{k}/rank{r}" + (f"/seed{s}" if k == "random_subspace" else ""): (k, r, s) for k, r, s in kinds}
    jobs = frames.select(*keys, "time_index", "role", "x").withColumn("variant", F.explode(F.array(*map(F.lit, by_name))))

    def project(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("time_index", kind="stable")
        x, train = np.stack(own["x"].to_list()), (own["role"] == "train").to_numpy()
        kind, rank, seed = by_name[own["variant"].iloc[0]]
        rank = min(rank, x.shape[1], int(train.sum()) - 1)
        run = {"pca": lambda: models.pca_projection(x[train], x, rank), "random_subspace": lambda: models.random_projection(x[train], x, rank, seed), "factor_analysis": lambda: models.factor_projection(x[train], x, rank), "sparse_pca": lambda: models.sparse_projection(x[train], x, rank), "nmf": lambda: models.nonnegative_projection(x[train], x, rank, seed)}
        return own.assign(x=list(run[kind]()))

    return jobs.groupBy(*keys, "variant").applyInPandas(project, f"{_types(frames, keys)}, time_index int, role string, x {_VECTOR}, variant string")
