"""Directed interaction graphs as edge tables: inference by grouped kernels, significance, stability and recovery in SQL."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pearson, safe_divide
from ..kernels import granger
from . import lagged
from .bss import _types

REC = ("recording",)


def dependence_tests(wide: DataFrame, depths: Sequence[int], method: str = "cgc", draws: int = 1000, seed: int = 0, keys: Sequence[str] = REC, alpha: float = 1.0, block: int = 16) -> DataFrame:
    """tests(keys, depth, source, lag, target, corr, corr_p, inv_corr, inv_p) of each panel at each conditioning depth.

    Each (panel, depth, block of sources) is a group of its own, as shifts need whole series; pairs whose corr_p exceeds alpha skip the conditional
    test (inv_p is 1).
    """
    blocks = F.sequence(F.lit(0), F.greatest(F.size("x") - 1, F.lit(0)), F.lit(block))
    jobs = wide.select(*keys, "time_index", "x").withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("_from", F.explode(blocks))

    def test(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("time_index", kind="stable")
        x, start = np.stack(own["x"].to_list()), int(own["_from"].iloc[0])
        found = granger.dependence(x, int(own["depth"].iloc[0]), method, draws, seed, alpha, range(start, min(start + block, x.shape[1])))
        n = len(found["corr"])
        return pd.DataFrame({k: [own[k].iloc[0]] * n for k in (*keys, "depth")} | found)

    schema = f"{_types(wide, keys)}, depth int, source int, lag int, target int, corr double, corr_p double, inv_corr double, inv_p double"
    return jobs.groupBy(*keys, "depth", "_from").applyInPandas(test, schema)


def significant_edges(tests: DataFrame, alpha: float = 0.01, beta: float = 0.001, n_lags: int | None = None, simulation: bool = False, keys: Sequence[str] = REC) -> DataFrame:
    """Edges significant in both tests at any used lag, weighted by the correlation at lag 0. simulation leaves lag 0 out where others exist."""
    used = tests if n_lags is None else tests.filter(F.col("lag") <= n_lags)
    if simulation:
        used = used.filter((F.col("lag") > 0) | (F.col("depth") == 0))
    hit = (F.col("corr_p") <= alpha) & (F.col("inv_p") <= beta) & (F.col("corr") > 0) & (F.col("inv_corr") > 0)
    edges = used.filter(hit).select(*keys, "depth", "source", "target").distinct()
    now = tests.filter("lag = 0").select(*keys, "depth", "source", "target", F.col("corr").alias("weight"))
    return edges.join(now, [*keys, "depth", "source", "target"])


def var_edges(wide: DataFrame, depths: Sequence[int], threshold: float = 0.08, keys: Sequence[str] = REC) -> DataFrame:
    """Edges whose least-squares VAR coefficient exceeds the threshold in size at any lag, off the diagonal; weight is the largest size."""
    out = None
    for depth in dict.fromkeys(depths):
        b = lagged.var_coefficients(wide, depth, keys).filter("source <> target").groupBy(*keys, "source", "target").agg(F.max(F.abs("coefficient")).alias("weight"))
        own = b.filter(F.col("weight") > threshold).select(*keys, F.lit(depth).alias("depth"), "source", "target", "weight")
        out = own if out is None else out.unionByName(own)
    return out


def off_diagonal(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("source") != F.col("target")) & (F.col("weight") != 0))


def edge_counts(edges: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    return off_diagonal(edges).groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("n_edges"))


def instability(edges: DataFrame, nodes: int, depths: Sequence[int], keys: Sequence[str] = REC) -> DataFrame:
    """For each depth but the first: share of ordered pairs whose edge differs from the depth before, split into losses and gains."""
    order = sorted(depths)
    own = off_diagonal(edges).select(*keys, "depth", "source", "target").distinct()
    step = F.create_map(*(F.lit(v) for i, d in enumerate(order) for v in (d, i)))
    placed = own.withColumn("_s", step[F.col("depth")])
    both = placed.select(*keys, "source", "target", F.col("_s").alias("_at"), F.lit(1).alias("_now"), F.lit(0).alias("_then")).unionByName(
        placed.select(*keys, "source", "target", (F.col("_s") + 1).alias("_at"), F.lit(0).alias("_now"), F.lit(1).alias("_then"))
    )
    both = both.filter((F.col("_at") >= 1) & (F.col("_at") < len(order))).groupBy(*keys, "_at", "source", "target").agg(F.max("_now").alias("_now"), F.max("_then").alias("_then"))
    pairs = F.lit(float(nodes * (nodes - 1)))
    moved = both.groupBy(*keys, "_at").agg((F.sum(F.greatest(F.col("_then") - F.col("_now"), F.lit(0))) / pairs).alias("d_minus"), (F.sum(F.greatest(F.col("_now") - F.col("_then"), F.lit(0))) / pairs).alias("d_plus"))
    grid = own.select(*keys).distinct().withColumn("_at", F.explode(F.sequence(F.lit(1), F.lit(len(order) - 1))))
    depth = F.array(*map(F.lit, order))[F.col("_at")]
    full = grid.join(moved, [*keys, "_at"], "left").fillna(0.0, ["d_minus", "d_plus"])
    return full.select(*keys, depth.alias("depth"), (F.col("d_minus") + F.col("d_plus")).alias("d_p"), "d_minus", "d_plus")


def stability_statistic(changes: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Largest instability over depths."""
    return changes.groupBy(*keys).agg(F.max("d_p").alias("t_obs"))


def recovery(predicted: DataFrame, truth: DataFrame, nodes: int, keys: Sequence[str] = ("recording", "depth")) -> DataFrame:
    """Confusion counts over ordered pairs, accuracy, precision, recall, fpr, balanced accuracy, F1 and Hamming distance to truth(source, target)."""
    p = off_diagonal(predicted).select(*keys, "source", "target").distinct().withColumn("_p", F.lit(1))
    t = truth.filter("source <> target").select("source", "target").distinct()
    hits = p.join(t.withColumn("_t", F.lit(1)), ["source", "target"], "left").groupBy(*keys).agg(F.count("_t").alias("_hit"), F.count(F.lit(1)).alias("_all"))
    size = t.agg(F.count(F.lit(1)).alias("_true"))  # one row
    one = lambda c: F.coalesce(F.col(c), F.lit(0))
    c = predicted.select(*keys).distinct().join(hits, list(keys), "left").crossJoin(F.broadcast(size))
    c = c.select(*keys, one("_hit").alias("tp"), (one("_all") - one("_hit")).alias("fp"), (F.col("_true") - one("_hit")).alias("fn"))
    c = c.withColumn("tn", F.lit(nodes * (nodes - 1)) - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(safe_divide(a.cast("double"), b), F.lit(0.0))
    return c.withColumns({"accuracy": zero(tp + tn, tp + tn + fp + fn), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "fpr": zero(fp, fp + tn), "balanced_accuracy": (zero(tp, tp + fn) + zero(tn, tn + fp)) / 2, "f1": zero(2 * tp, 2 * tp + fp + fn), "shd": fp + fn})


def upsert_edges(stored: DataFrame, new: DataFrame, by: str = "variant", replace: bool = True) -> DataFrame:
    """stored without the keys of new, and new; raises if a key is there already and may not be replaced."""
    keys = new.select(by).distinct()
    if not replace and (there := stored.join(keys, by, "left_semi").select(by).distinct().limit(3).collect()):
        raise FileExistsError(f"already stored: {[r[by] for r in there]}")
    return stored.join(keys, by, "left_anti").unionByName(new)


def cluster_agreement(labels: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Adjusted Rand index of every unordered pair of labelings(keys, labeling, component, cluster) with sorted names."""
    a = labels.select(*keys, F.col("labeling").alias("left"), "component", F.col("cluster").alias("_a"))
    b = labels.select(*keys, F.col("labeling").alias("right"), "component", F.col("cluster").alias("_b"))
    from .setops import adjusted_rand

    return adjusted_rand(a.join(b, [*keys, "component"]).filter("left < right"), "_a", "_b", [*keys, "left", "right"])


def labeling_stability(labels: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Agreement of every unordered pair of labelings(keys, labeling, component, cluster, cluster_rank, retained) with sorted names: the adjusted
    Rand index, the Jaccard index of the retained components (1 if neither retains any) and Spearman's correlation of the components' cluster
    ranks (NULL where either side is constant).
    """
    own = Window.partitionBy(*keys, "labeling")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "labeling", "cluster_rank"))
    ranked = labels.withColumn("_r", F.rank().over(own.orderBy("cluster_rank")) + (ties - 1) / F.lit(2.0))
    side = lambda name: ranked.select(*keys, F.col("labeling").alias(name), "component", F.col("retained").alias(f"_kept_{name}"), F.col("_r").alias(f"_r_{name}"))
    met = side("left").join(side("right"), [*keys, "component"]).filter("left < right")
    both, either = F.count_if(F.col("_kept_left") & F.col("_kept_right")), F.count_if(F.col("_kept_left") | F.col("_kept_right"))
    out = met.groupBy(*keys, "left", "right").agg(F.coalesce(safe_divide(both.cast("double"), either), F.lit(1.0)).alias("retained_jaccard"), pearson("_r_left", "_r_right").alias("rank_spearman"))
    return cluster_agreement(labels, keys).join(out, [*keys, "left", "right"])
