"""Queries over scorecards, unit effects and probe centers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded as r6
from ..operators import reports
from ..operators.preprocess import marks_to_edges, order_variants
from ..sources.panels import frames, table
from .metrics import _rounded
from .preprocess import WIDE


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fold metrics: nations are recordings, line numbers components, return flags and a remainder methods."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    method = F.element_at(F.array(F.lit("raw"), F.lit("clean"), F.lit("other")), (F.col("l_partkey") % 3 + 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "N", "null").otherwise("score")
    scope = F.when(F.col("l_linenumber") < 4, "within").otherwise("transfer")
    return li.select(F.col("s_nationkey").alias("recording"), method.alias("method"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("component"), scope.alias("scope"), kind.alias("kind"), F.col("l_discount").alias("value"))


_SCORES = """m AS (SELECT s_nationkey AS recording, ['raw', 'clean', 'other'][l_partkey % 3 + 1] AS method, 'c' || l_linenumber AS component, CASE WHEN l_linenumber < 4 THEN 'within' ELSE 'transfer' END AS scope, CASE WHEN l_returnflag = 'N' THEN 'null' ELSE 'score' END AS kind, l_discount AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
o AS (SELECT recording, component, scope, method, avg(value) AS score FROM m WHERE kind = 'score' GROUP BY 1, 2, 3, 4), u AS (SELECT recording, component, scope, avg(value) AS null_score FROM m WHERE kind = 'null' GROUP BY 1, 2, 3),
c AS (SELECT o.*, r.score AS raw_score, null_score FROM o LEFT JOIN o r ON r.recording = o.recording AND r.component = o.component AND r.scope = o.scope AND r.method = 'raw' LEFT JOIN u ON u.recording = o.recording AND u.component = o.component AND u.scope = o.scope)"""


def bpi_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.component_scores(_metrics(spark, sf_dir)), "recording", "method", "component", "scope")


COMPONENTS = f"WITH {_SCORES} SELECT recording, method, component, scope, round(score, 6) + 0.0 AS score, round(raw_score, 6) + 0.0 AS raw_score, round(null_score, 6) + 0.0 AS null_score FROM c"


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.preservation_scorecard(reports.component_scores(_metrics(spark, sf_dir))), "recording", "method").withColumn("preservation", F.round("preservation", 3) + 0.0)


SCORECARD = f"WITH {_SCORES}, p AS (SELECT *, CASE WHEN raw_score > null_score THEN 100.0 * (score - null_score) / (raw_score - null_score) END AS p FROM c) SELECT recording, method, round(avg(p), 3) + 0.0 AS preservation, count(p) AS n_components FROM p GROUP BY 1, 2"


def unit_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outcomes at two levels of units; p values only where there are few enough units."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.select("n_nationkey", "n_regionkey", F.col("c_mktsegment").alias("method"), F.col("c_acctbal").alias("balance"), F.abs("c_acctbal").alias("size"))
    out = reports.primary_unit_effects(r, ["balance", "size"], ["n_nationkey", "n_regionkey"], "BUILDING")
    return out.select("unit", "outcome", "method", "n_units", r6("median_difference").alias("median_difference"), "n_positive")


UNIT_EFFECTS = """WITH r AS (SELECT n_nationkey, n_regionkey, c_mktsegment AS method, c_acctbal AS balance, abs(c_acctbal) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT 'n_nationkey' AS unit, n_nationkey AS u, 'balance' AS outcome, method, balance AS v FROM r UNION ALL SELECT 'n_nationkey', n_nationkey, 'size', method, size FROM r UNION ALL SELECT 'n_regionkey', n_regionkey, 'balance', method, balance FROM r UNION ALL SELECT 'n_regionkey', n_regionkey, 'size', method, size FROM r),
a AS (SELECT unit, u, outcome, method, avg(v) AS v FROM l GROUP BY 1, 2, 3, 4)
SELECT x.unit, x.outcome, x.method, count(*) AS n_units, round(median(x.v - y.v), 6) + 0.0 AS median_difference, count_if(x.v - y.v > 0) AS n_positive FROM a x JOIN a y ON y.unit = x.unit AND y.u = x.u AND y.outcome = x.outcome AND y.method = 'BUILDING' WHERE x.method <> 'BUILDING' GROUP BY 1, 2, 3"""


def probe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.probe_scores(frames(spark, sf_dir)), "recording", "time_index")


PROBES = f"""WITH {WIDE}, b AS (SELECT recording, time_index, x, coalesce(lag(x, 1) OVER (PARTITION BY recording ORDER BY time_index), x) AS y FROM wide),
s AS (SELECT recording, time_index, list_sum(list_transform(x, lambda v: abs(v))) / len(x) AS a, list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) / len(x) AS d FROM b),
m AS (SELECT *, median(a) OVER w AS ma, median(d) OVER w AS md FROM s WINDOW w AS (PARTITION BY recording)), q AS (SELECT recording, 1.4826 * median(abs(a - ma)) AS sa, 1.4826 * median(abs(d - md)) AS sd FROM m GROUP BY 1)
SELECT recording, time_index, round((a - ma) / sa + (d - md) / sd, 6) + 0.0 AS score FROM m JOIN q USING (recording)"""


def probe_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.separated_top(_rounded(reports.probe_scores(frames(spark, sf_dir)), "recording", "time_index"), 5, 20, 6)


#: The highest frame that keeps its distance, time after time.
CENTERS = f"""{PROBES.replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT recording, time_index", 1)[0].rstrip()},
scores AS (SELECT recording, time_index{PROBES.rsplit("SELECT recording, time_index", 1)[1]}),
inner_frames AS (SELECT *, max(time_index) OVER (PARTITION BY recording) AS last FROM scores QUALIFY time_index BETWEEN 6 AND last - 6),
picked AS (
 SELECT DISTINCT recording, 0 AS k, CAST([] AS INTEGER[]) AS chosen FROM scores
 UNION ALL
 SELECT p.recording, p.k + 1, list_append(p.chosen, max_by(f.time_index, struct_pack(s := f.score, t := -f.time_index)))
 FROM picked p JOIN inner_frames f ON f.recording = p.recording AND len(list_filter(p.chosen, lambda c: abs(c - f.time_index) < 20)) = 0 WHERE p.k < 5 GROUP BY p.recording, p.k, p.chosen)
SELECT recording, time_index, score FROM scores SEMI JOIN (SELECT recording, unnest(chosen) AS time_index FROM picked) USING (recording, time_index)"""


def edge_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge marks by order priority: directed ones only, over all lags."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mark = F.element_at(F.array(F.lit("-->"), F.lit("<--"), F.lit("o-o"), F.lit("<->"), F.lit("")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return marks_to_edges(o.select(F.col("c_nationkey").alias("source"), F.col("o_orderpriority").alias("target"), F.lit(0).alias("lag"), mark.alias("mark")))


EDGE_MARKS = "SELECT DISTINCT c_nationkey AS source, o_orderpriority AS target FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0"


def variant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("variant")).distinct()
    return order_variants(names, "ECONOMY", ["PROMO", "STANDARD"])


VARIANT_ORDER = "SELECT DISTINCT p_type AS variant, CAST(CASE WHEN p_type = 'ECONOMY' THEN -1 WHEN contains(p_type, 'PROMO') THEN 0 WHEN contains(p_type, 'STANDARD') THEN 1 ELSE 2 END AS INTEGER) AS variant_order FROM part"

QUERIES = {"bpi_component_scores": bpi_components, "preservation_scorecard": scorecard, "primary_unit_effects": unit_effects, "probe_scores": probe_scores, "probe_centers": probe_centers, "edge_marks": edge_marks, "variant_order": variant_order}
ORACLES = {"bpi_component_scores": COMPONENTS, "preservation_scorecard": SCORECARD, "primary_unit_effects": UNIT_EFFECTS, "probe_scores": PROBES, "probe_centers": CENTERS, "edge_marks": EDGE_MARKS, "variant_order": VARIANT_ORDER}
