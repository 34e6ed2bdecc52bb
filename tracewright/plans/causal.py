"""Queries over graphs of dependence and causal links, and over the lagged sums that they come from.

Domain on the given tables: by return flag a panel of five series, revenue by the suppliers' region in periods of 14 days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causal, graphs, lagged, metrics
from ..sources.panels import frames, table, traces, wide_form
from .metrics import VARIANTS, _rounded


def _region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    met = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    week = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 14).cast("int")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value")
    sums = met.groupBy(F.col("l_returnflag").alias("recording"), week.alias("time_index"), F.col("n_regionkey").cast("int").alias("neuron")).agg(revenue)
    grid = sums.select("recording", "time_index").distinct().withColumn("neuron", F.explode(F.sequence(F.lit(0), F.lit(4))))
    full = grid.join(sums, ["recording", "time_index", "neuron"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return wide_form(full)


#: stacked(recording, depth, t, place, v): frame t's series `place % 5`, `place // 5` frames earlier, for frames with `depth` frames before them.
STACKED = """sums AS (
 SELECT l_returnflag AS recording, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 14.0) AS INTEGER) AS t, CAST(n_regionkey AS INTEGER) AS neuron,
  sum(l_extendedprice * (1 - l_discount)) AS value
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
panel AS (
 SELECT g.recording, g.t, g.neuron, coalesce(s.value, 0) AS value
 FROM (SELECT recording, t, CAST(unnest(range(5)) AS INTEGER) AS neuron FROM (SELECT DISTINCT recording, t FROM sums)) g LEFT JOIN sums s USING (recording, t, neuron)),
depths AS (SELECT CAST(unnest([1, 2]) AS INTEGER) AS depth),
whole AS (
 SELECT depth, a.recording, a.t FROM depths, (SELECT DISTINCT recording, t FROM panel) a JOIN (SELECT DISTINCT recording, t FROM panel) b
 ON b.recording = a.recording AND b.t BETWEEN a.t - depth AND a.t GROUP BY 1, 2, 3 HAVING count(*) = depth + 1),
stacked AS (
 SELECT w.recording, w.depth, w.t, (w.t - p.t) * 5 + p.neuron AS place, p.value AS v
 FROM whole w JOIN panel p ON p.recording = w.recording AND p.t BETWEEN w.t - w.depth AND w.t)"""


def granger_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested at depths 1 and 2 by both conditioning rules, with the operators' own draws and levels."""
    panel = _region_panel(spark, sf_dir)
    parts = [graphs.significant_edges(graphs.dependence_tests(panel, [1, 2], m, seed=7)).withColumn("method", F.lit(m)) for m in ("cgc", "fcgc")]
    return _rounded(parts[0].unionByName(parts[1]), "recording", "depth", "source", "target", "method")


def var_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graphs.var_edges(_region_panel(spark, sf_dir), [1, 2]), "recording", "depth", "source", "target")


#: Normal equations, solved by Gauss and Jordan's elimination: row i and column j hold past places, columns from 1000 the targets.
VAR = f"""WITH RECURSIVE {STACKED},
normal AS (
 SELECT a.recording, a.depth, a.place - 5 AS i, CASE WHEN b.place < 5 THEN 1000 + b.place ELSE b.place - 5 END AS j, sum(a.v * b.v) AS v
 FROM stacked a JOIN stacked b USING (recording, depth, t) WHERE a.place >= 5 GROUP BY 1, 2, 3, 4),
solved AS (
 SELECT 0 AS k, * FROM normal
 UNION ALL
 SELECT a.k + 1, a.recording, a.depth, a.i, a.j, CASE WHEN a.i = a.k THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END
 FROM solved a JOIN solved p ON p.recording = a.recording AND p.depth = a.depth AND p.i = a.k AND p.j = a.k
 JOIN solved r ON r.recording = a.recording AND r.depth = a.depth AND r.i = a.k AND r.j = a.j
 JOIN solved c ON c.recording = a.recording AND c.depth = a.depth AND c.i = a.i AND c.j = a.k
 WHERE a.k < 5 * a.depth),
sizes AS (SELECT recording, depth, i % 5 AS source, j - 1000 AS target, max(abs(v)) AS weight FROM solved WHERE k = 5 * depth AND j >= 1000 GROUP BY 1, 2, 3, 4)
SELECT recording, depth, source, target, round(weight, 6) + 0.0 AS weight FROM sizes WHERE source <> target AND weight > 0.08"""


def low_order_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = causal.low_order_tests(_region_panel(spark, sf_dir), 2).drop("p")
    return _rounded(found, "recording", "source", "lag", "target", "given_source", "given_lag")


LOW_ORDER = f"""WITH {STACKED},
r AS (SELECT recording, a.place AS a, b.place AS b, corr(a.v, b.v) AS r FROM stacked a JOIN stacked b USING (recording, depth, t) WHERE depth = 2 GROUP BY 1, 2, 3),
pairs AS (SELECT recording, a AS x, b AS y, r FROM r WHERE b < 5 AND a <> b),
tests AS (
 SELECT recording, x, y, NULL AS z, r FROM pairs
 UNION ALL
 SELECT p.recording, p.x, p.y, xz.b, (p.r - xz.r * yz.r) / sqrt((1 - xz.r * xz.r) * (1 - yz.r * yz.r))
 FROM pairs p JOIN r xz ON xz.recording = p.recording AND xz.a = p.x AND xz.b NOT IN (p.x, p.y) JOIN r yz ON yz.recording = p.recording AND yz.a = p.y AND yz.b = xz.b)
SELECT recording, x % 5 AS source, x // 5 AS lag, y AS target, z % 5 AS given_source, z // 5 AS given_lag, round(r, 6) + 0.0 AS r FROM tests"""


def pcmci_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(causal.pcmci_plus(_region_panel(spark, sf_dir), 2, 0.05), "recording", "source", "lag", "target", "mark")


def jpcmci_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph for all return flags, with the flag and the year as dummies."""
    return _rounded(causal.jpcmci_plus(_region_panel(spark, sf_dir), 2, 0.05, time_block=26), "source", "lag", "target", "mark")


def cross_correlation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and smoothed recordings of 64 neurons: all neurons with all others at three lags."""
    both = wide_form(metrics.variants_of(traces(spark, sf_dir)), ("recording", "variant", "time_index"))
    return _rounded(lagged.temporal_dependence_change(both, (1, 2, 5)), "recording", "variant", "lag")


XCF = f"""WITH {VARIANTS},
z AS (SELECT recording, variant, neuron, time_index, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END AS z FROM variants WINDOW w AS (PARTITION BY recording, variant, neuron)),
c AS (
 SELECT b.recording, b.variant, k AS lag, a.neuron AS source, b.neuron AS target, avg(a.z * b.z) AS r
 FROM (VALUES (1), (2), (5)) l(k), z a, z b WHERE a.recording = b.recording AND a.variant = b.variant AND a.time_index = b.time_index - k GROUP BY 1, 2, 3, 4, 5)
SELECT c.recording, c.variant, CAST(c.lag AS INTEGER) AS lag, round(sqrt(sum((c.r - o.r) ** 2)) / sqrt(sum(o.r ** 2)), 6) + 0.0 AS xcf_relative_change,
 round(median(abs(c.r - o.r)) FILTER (c.source = c.target), 6) + 0.0 AS acf_change_median
FROM c JOIN c o ON o.recording = c.recording AND o.lag = c.lag AND o.source = c.source AND o.target = c.target AND o.variant = 'raw' GROUP BY 1, 2, 3"""


def lagged_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of centered recordings, over chunks of 100 frames."""
    rows = frames(spark, sf_dir).select("recording", "time_index", "x")
    found = lagged.lagged_covariances(lagged.standardized(rows), (1, 3), chunk=100)
    return _rounded(found, "recording", "lag", "source", "target")


COVARIANCES = f"""WITH {VARIANTS},
z AS (SELECT recording, neuron, time_index, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END AS z FROM variants WHERE variant = 'raw' WINDOW w AS (PARTITION BY recording, neuron)),
c AS (
 SELECT b.recording, CAST(k AS INTEGER) AS lag, a.neuron AS source, b.neuron AS target, avg(a.z * b.z) AS r
 FROM (VALUES (1), (3)) l(k), z a, z b WHERE a.recording = b.recording AND a.time_index = b.time_index - k GROUP BY 1, 2, 3, 4)
SELECT c.recording, c.lag, c.source, c.target, round((c.r + o.r) / 2, 6) + 0.0 AS covariance FROM c JOIN c o ON o.recording = c.recording AND o.lag = c.lag AND o.source = c.target AND o.target = c.source"""

QUERIES = {
    "granger_graph": granger_graph, "var_graph": var_graph, "low_order_tests": low_order_tests, "pcmci_graph": pcmci_graph, "jpcmci_graph": jpcmci_graph,
    "cross_correlation_change": cross_correlation_change, "lagged_covariances": lagged_covariances,
}
ORACLES = {"var_graph": VAR, "low_order_tests": LOW_ORDER, "cross_correlation_change": XCF, "lagged_covariances": COVARIANCES}
