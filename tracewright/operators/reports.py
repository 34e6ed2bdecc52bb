"""Scorecards over recordings, probe centers, user-supplied graph methods and small reports."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MAD_SCALE, median, safe_divide
from .bss import _types
from .metrics import recording_effects

#: Graph methods by name: functions of a time-by-series matrix and a depth that return a square matrix of edge weights.
METHODS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {}


def register_method(name: str, function: Callable[[np.ndarray, int], np.ndarray]) -> None:
    if name in METHODS:
        raise ValueError(f"{name!r} is there already")
    METHODS[name] = function


def user_edges(wide: DataFrame, name: str, depths: Sequence[int], keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Off-diagonal nonzero edges of a registered method for each panel and depth; its output's shape is checked."""
    if name not in METHODS:
        raise KeyError(f"unknown method {name!r}; there are {sorted(METHODS)}")
    function = METHODS[name]
    jobs = wide.select(*keys, "time_index", "x").withColumn("depth", F.explode(F.array(*map(F.lit, depths))))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("time_index", kind="stable")
        x = np.stack(own["x"].to_list())
        a = np.asarray(function(x, int(own["depth"].iloc[0])), float)
        if a.shape != (x.shape[1], x.shape[1]):
            raise ValueError(f"{name}: a matrix of shape {a.shape} for {x.shape[1]} series")
        np.fill_diagonal(a, 0)
        s, t = np.nonzero(a)
        return pd.DataFrame({k: [own[k].iloc[0]] * len(s) for k in (*keys, "depth")} | {"source": s, "target": t, "weight": a[s, t]})

    return jobs.groupBy(*keys, "depth").applyInPandas(run, f"{_types(wide, keys)}, depth int, source int, target int, weight double")


def component_scores(metrics: DataFrame, reference: str = "raw") -> DataFrame:
    """metrics(recording, method, component, scope, kind, value) with kind score or null become one row for each recording, method and
    component: its mean score, the reference's, and the mean null score.
    """
    keys = ["recording", "component", "scope"]
    own = metrics.filter("kind = 'score'").groupBy(*keys, "method").agg(F.avg("value").alias("score"))
    raw = own.filter(F.col("method") == reference).select(*keys, F.col("score").alias("raw_score"))
    null = metrics.filter("kind = 'null'").groupBy(*keys).agg(F.avg("value").alias("null_score"))
    return own.join(raw, keys, "left").join(null, keys, "left").select("recording", "method", "component", "scope", "score", "raw_score", "null_score")


def preservation_scorecard(scores: DataFrame, reference: str = "raw") -> DataFrame:
    """Mean percentage of the reference's advantage over null that a method keeps, over components where the reference has one."""
    kept = F.when(F.col("raw_score") > F.col("null_score"), 100.0 * (F.col("score") - F.col("null_score")) / (F.col("raw_score") - F.col("null_score")))
    return scores.withColumn("_p", kept).groupBy("recording", "method").agg(F.avg("_p").alias("preservation"), F.count("_p").alias("n_components"))


def primary_unit_effects(results: DataFrame, outcomes: Sequence[str], units: Sequence[str], reference: str = "raw") -> DataFrame:
    """Paired effects of each outcome over units at each level (recordings, animals), one below the other."""
    out = None
    for unit in units:
        for outcome in outcomes:
            part = recording_effects(results.filter(F.col(outcome).isNotNull()), outcome, reference, unit).withColumns({"unit": F.lit(unit), "outcome": F.lit(outcome)})
            out = part if out is None else out.unionByName(part)
    return out


def probe_scores(wide: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """How much each frame stands out: robust z of the mean absolute amplitude plus that of its mean absolute change."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("time_index")
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(c)
    rows = wide.withColumn("_before", F.coalesce(F.lag("x", 1).over(w), F.col("x")))
    rows = rows.select(*keys, "time_index", size(F.col("x")).alias("_a"), size(F.zip_with("x", "_before", lambda x, b: x - b)).alias("_d"))
    mid = rows.groupBy(*keys).agg(median("_a").alias("_ma"), median("_d").alias("_md"))
    rows = rows.join(mid, list(keys))
    spread = rows.groupBy(*keys).agg((MAD_SCALE * median(F.abs(F.col("_a") - F.col("_ma")))).alias("_sa"), (MAD_SCALE * median(F.abs(F.col("_d") - F.col("_md")))).alias("_sd"))
    z = lambda v, m, s: F.coalesce(safe_divide(F.col(v) - F.col(m), F.when(F.col(s) > 0, F.col(s))), F.lit(0.0))
    return rows.join(spread, list(keys)).select(*keys, "time_index", (z("_a", "_ma", "_sa") + z("_d", "_md", "_sd")).alias("score"))


def separated_top(scores: DataFrame, n: int, separation: int, edge: int = 0, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """The n highest frames of each key that keep `separation` frames apart and `edge` frames from the ends; ties to the earlier frame."""

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        last = own["time_index"].max()
        own = own[(own["time_index"] >= edge) & (own["time_index"] <= last - edge)].sort_values(["score", "time_index"], ascending=[False, True])
        chosen: list[int] = []
        for t in own["time_index"]:
            if all(abs(t - c) >= separation for c in chosen):
                chosen.append(int(t))
                if len(chosen) == n:
                    break
        return own[own["time_index"].isin(chosen)]

    return scores.groupBy(*keys).applyInPandas(pick, f"{_types(scores, keys)}, time_index int, score double")


def html_report(table: DataFrame, title: str, most_rows: int = 1000) -> str:
    """A table as HTML in the order of its columns, each row classed by its recommendation; beyond most_rows it says how many rows are left out."""
    rows = table.orderBy(*(f"`{c}`" for c in table.columns)).limit(most_rows).collect()
    left = table.count() - len(rows) if len(rows) == most_rows else 0
    cells = lambda r, tag: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in r)
    body = "".join(f'<tr class="{html.escape(str(r["recommendation"])) if "recommendation" in table.columns else "row"}">{cells(r, "td")}</tr>' for r in rows)
    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{cells(table.columns, 'th')}</tr>{body}</table>{f"<p>{left} more rows</p>" if left else ""}</body></html>"
