"""Queries over preprocessing operators, with the same in DuckDB's SQL.

Domain on the given tables: embeddings in id order are recordings of 250 frames by 64 neurons; a user's events in time order are a behaviour
signal. Gaps that the tables lack are made by the same rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded as r6
from ..operators import folds, preprocess as p
from ..sources.panels import frames, signals, table, traces

WIDE = """wide AS (SELECT CAST(vec_id // 250 AS INTEGER) AS recording, CAST(vec_id % 250 AS INTEGER) AS time_index, CAST(embedding AS DOUBLE[]) AS x,
 CAST(label >= 5 AS INTEGER) AS bout_state, CAST(label AS DOUBLE) AS level FROM embeddings)"""
LONG = WIDE + """,
traces AS (SELECT recording, time_index, CAST(unnest(range(len(x))) AS INTEGER) AS neuron, unnest(x) AS value FROM wide)"""
SIGNAL = """signal AS (SELECT user_id AS recording, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS sample_index, CAST(value AS DOUBLE) AS value FROM events)"""


def moving_average_sql(source: str, value: str, window: int, keys: str, order: str, name: str = "smooth") -> str:
    b, a = window // 2, window - 1 - window // 2
    return f"""SELECT *, (sum({value}) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)
 + greatest(0, {b} - (row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1)) * first_value({value}) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
 + greatest(0, {a} - (count(*) OVER (PARTITION BY {keys}) - row_number() OVER (PARTITION BY {keys} ORDER BY {order}))) * last_value({value}) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {window}.0 AS {name} FROM {source}"""


def binned_sql(source: str, n: int, how: str, name: str) -> str:
    """Bins of a signal (recording, sample_index, value); how: an aggregate over value; an empty bin takes one sample."""
    single = "abs(o.value)" if "sqrt" in how else "o.value"
    return f"""SELECT g.recording, g.frame, coalesce(f.v, {single}) AS {name} FROM
 (SELECT recording, n, CAST(unnest(range({n})) AS INTEGER) AS frame FROM (SELECT recording, count(*) AS n FROM {source} GROUP BY 1)) g
 LEFT JOIN (SELECT e.recording, e.frame, {how} AS v FROM (SELECT recording, n, CAST(unnest(range({n})) AS INTEGER) AS frame FROM (SELECT recording, count(*) AS n FROM {source} GROUP BY 1)) e
   JOIN {source} s ON s.recording = e.recording AND s.sample_index >= round_even(e.frame * e.n / {n}.0, 0) AND s.sample_index < round_even((e.frame + 1) * e.n / {n}.0, 0) GROUP BY 1, 2) f
 ON f.recording = g.recording AND f.frame = g.frame
 LEFT JOIN {source} o ON o.recording = g.recording AND o.sample_index = least(round_even(g.frame * g.n / {n}.0, 0), g.n - 1)"""


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).withColumn("value", F.when(F.col("sample_index") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("value")))
    return p.impute_by_median(s, ("recording",)).select("recording", "sample_index", r6("value").alias("value"))


IMPUTED = f"""WITH {SIGNAL}, g AS (SELECT recording, sample_index, CASE WHEN sample_index % 7 = 3 THEN NULL ELSE value END AS value FROM signal)
SELECT recording, sample_index, round(coalesce(value, median(value) OVER (PARTITION BY recording), 0.0), 6) + 0.0 AS value FROM g"""


def cell_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = frames(spark, sf_dir).select("recording").distinct().withColumns({"emitter": F.array(F.lit(4), F.lit(1)), "receiver": F.array(F.lit(3), F.lit(5), F.lit(1))})
    return p.subset_cells(traces(spark, sf_dir), roles.withColumns({"emitter": F.col("emitter"), "receiver": F.col("receiver")})).groupBy("recording", "neuron").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


CELL_SUBSET = f"""WITH {LONG}, o AS (SELECT * FROM (VALUES (4, 0), (1, 1), (3, 2), (5, 3)) t(cell, place))
SELECT recording, place AS neuron, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM traces JOIN o ON neuron = cell GROUP BY 1, 2"""


def good_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = frames(spark, sf_dir)
    bad = wide.filter(F.col("level") == 3).select("recording", "time_index")
    return p.drop_bad_frames(wide, bad).select("recording", "time_index", "original_frame", r6(F.col("x")[0]).alias("first_cell"))


GOOD_FRAMES = f"""WITH {WIDE} SELECT recording, CAST(row_number() OVER (PARTITION BY recording ORDER BY time_index) - 1 AS INTEGER) AS time_index, time_index AS original_frame, round(x[1], 6) + 0.0 AS first_cell
FROM wide WHERE level <> 3"""


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = p.bin_to_frames(signals(spark, sf_dir), 12, ("mean", "median", "rms"))
    return b.select("recording", "frame", *(r6(c).alias(c) for c in ("mean", "median", "rms")))


BINNED = f"""WITH {SIGNAL}, a AS ({binned_sql("signal", 12, "avg(s.value)", "v")}), b AS ({binned_sql("signal", 12, "median(s.value)", "v")}), c AS ({binned_sql("signal", 12, "sqrt(avg(s.value * s.value))", "v")})
SELECT a.recording, a.frame, round(a.v, 6) + 0.0 AS mean, round(b.v, 6) + 0.0 AS median, round(c.v, 6) + 0.0 AS rms FROM a JOIN b USING (recording, frame) JOIN c USING (recording, frame)"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.first_difference(signals(spark, sf_dir), "value", ["recording"], "sample_index").select("recording", "sample_index", r6("difference").alias("difference"))


DIFFERENCES = f"WITH {SIGNAL} SELECT recording, sample_index, round(value - lag(value, 1, value) OVER (PARTITION BY recording ORDER BY sample_index), 6) + 0.0 AS difference FROM signal"


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = p.moving_average(signals(spark, sf_dir), "value", 5, ["recording"], "sample_index", "odd")
    s = p.moving_average(s, "value", 4, ["recording"], "sample_index", "even")
    return s.select("recording", "sample_index", r6("odd").alias("odd"), r6("even").alias("even"))


SMOOTHED = f"""WITH {SIGNAL}, a AS ({moving_average_sql("signal", "value", 5, "recording", "sample_index", "odd")}), b AS ({moving_average_sql("a", "value", 4, "recording", "sample_index", "even")})
SELECT recording, sample_index, round(odd, 6) + 0.0 AS odd, round(even, 6) + 0.0 AS even FROM b"""


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    a = p.bout_state(s, "value", 0.75, ["recording"]).select("recording", "sample_index", "threshold", "bout_state")
    b = p.bout_state(s.withColumn("value", F.col("value") - 10), "value", 0.65, ["recording"], "positive_vigor_quantile").select("recording", "sample_index", F.col("bout_state").alias("positive_state"))
    return a.join(b, ["recording", "sample_index"]).select("recording", "sample_index", r6("threshold").alias("threshold"), "bout_state", "positive_state")


BOUTS = f"""WITH {SIGNAL}, q AS (SELECT recording, quantile_cont(value, 0.75) AS threshold, coalesce(quantile_cont(CASE WHEN value - 10 > 0 THEN value - 10 END, 0.65), 0) AS positive FROM signal GROUP BY 1)
SELECT recording, sample_index, round(threshold, 6) + 0.0 AS threshold, CAST(value >= threshold AS INTEGER) AS bout_state, CAST(value - 10 >= positive AS INTEGER) AS positive_state FROM signal JOIN q USING (recording)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = p.behavior_targets(signals(spark, sf_dir), 12)
    return t.select("recording", "frame", *(r6(c).alias(c) for c in ("angle", "raw_vigor", "vigor", "threshold")), "bout_state")


_CHANGE = "change AS (SELECT recording, sample_index, value - lag(value, 1, value) OVER (PARTITION BY recording ORDER BY sample_index) AS value FROM signal)"
_TARGETS = f"""WITH {SIGNAL}, {_CHANGE}, angle AS ({binned_sql("signal", 12, "avg(s.value)", "angle")}), raw AS ({binned_sql("change", 12, "sqrt(avg(s.value * s.value))", "raw_vigor")}),
vig AS ({moving_average_sql("raw", "raw_vigor", 3, "recording", "frame", "vigor")})"""
TARGETS = f"""{_TARGETS}, q AS (SELECT recording, quantile_cont(vigor, 0.75) AS threshold FROM vig GROUP BY 1)
SELECT recording, frame, round(angle, 6) + 0.0 AS angle, round(raw_vigor, 6) + 0.0 AS raw_vigor, round(vigor, 6) + 0.0 AS vigor, round(threshold, 6) + 0.0 AS threshold, CAST(vigor >= threshold AS INTEGER) AS bout_state
FROM angle JOIN vig USING (recording, frame) JOIN q USING (recording)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = p.target_grid(p.behavior_targets(signals(spark, sf_dir), 12), (0.5, 0.9), (1, 3))
    return g.groupBy("recording", "target_variant").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("y")).alias("total"))


GRID = f"""{_TARGETS}, one AS (SELECT recording, frame, raw_vigor AS v, 1 AS w FROM raw UNION ALL SELECT recording, frame, vigor, 3 FROM vig),
q AS (SELECT recording, w, quantile_cont(v, 0.5) AS q5, quantile_cont(v, 0.9) AS q9 FROM one GROUP BY 1, 2),
u AS (SELECT recording, 'angle' AS target_variant, angle AS y FROM angle UNION ALL SELECT recording, 'vigor_sw' || w, v FROM one
UNION ALL SELECT recording, 'bout_q0p5_sw' || w, CAST(v >= q5 AS INTEGER) FROM one JOIN q USING (recording, w) UNION ALL SELECT recording, 'bout_q0p9_sw' || w, CAST(v >= q9 AS INTEGER) FROM one JOIN q USING (recording, w))
SELECT recording, target_variant, count(*) AS n, round(sum(y), 6) + 0.0 AS total FROM u GROUP BY 1, 2"""


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = p.lagged_design(frames(spark, sf_dir), (3, 0, 1), 1, "level")
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return d.select("recording", "time_index", F.size("features").alias("width"), r6(F.col("features")[64]).alias("lag_1_first"), r6(total, 5).alias("total"), "y")


LAGGED = f"""WITH {WIDE}, d AS (SELECT recording, time_index, x, lag(x, 1) OVER w AS a, lag(x, 3) OVER w AS b, lead(level, 1) OVER w AS y FROM wide WINDOW w AS (PARTITION BY recording ORDER BY time_index))
SELECT recording, time_index, CAST(len(x) + len(a) + len(b) AS INTEGER) AS width, round(a[1], 6) + 0.0 AS lag_1_first, round(list_sum(x) + list_sum(a) + list_sum(b), 5) + 0.0 AS total, y FROM d WHERE b IS NOT NULL AND y IS NOT NULL"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = p.paired_windows(frames(spark, sf_dir), 4, 1, "level")
    return d.select("recording", "time_index", F.size("x0").alias("width"), r6(F.col("x0")[0]).alias("x0_first"), r6(F.element_at("x1", -1)).alias("x1_last"), "y")


WINDOWS = f"""WITH {WIDE}, d AS (SELECT recording, time_index, x, lag(x, 2) OVER w AS a, lead(x, 1) OVER w AS b, lead(level, 1) OVER w AS y FROM wide WINDOW w AS (PARTITION BY recording ORDER BY time_index))
SELECT recording, time_index, CAST(3 * len(x) AS INTEGER) AS width, round(a[1], 6) + 0.0 AS x0_first, round(b[-1], 6) + 0.0 AS x1_last, y FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL"""


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = p.standardize_by_train(traces(spark, sf_dir), F.col("time_index") < 200, ("recording", "neuron"))
    return z.select("recording", "time_index", "neuron", r6("z").alias("z"))


STANDARDIZED = f"""WITH {LONG}, f AS (SELECT recording, neuron, avg(value) FILTER (time_index < 200) AS m, stddev_pop(value) FILTER (time_index < 200) AS s FROM traces GROUP BY 1, 2)
SELECT recording, time_index, neuron, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS z FROM traces JOIN f USING (recording, neuron)"""


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = frames(spark, sf_dir).filter("time_index IN (1, 40, 120)").select("recording", F.col("time_index").alias("center"))
    return p.interpolate_window(traces(spark, sf_dir), centers, 2).select("recording", "center", "time_index", "neuron", r6("interpolated").alias("interpolated"))


INTERPOLATED = f"""WITH {LONG}, c AS (SELECT recording, time_index AS center FROM wide WHERE time_index IN (1, 40, 120)),
m AS (SELECT t.*, center, max(CASE WHEN time_index = center - 3 THEN value END) OVER w AS l, max(CASE WHEN time_index = center + 3 THEN value END) OVER w AS r FROM traces t JOIN c USING (recording)
 WHERE abs(time_index - center) <= 3 WINDOW w AS (PARTITION BY recording, center, neuron))
SELECT recording, center, time_index, neuron, round(l + (r - l) * (time_index - center + 3) / 6.0, 6) + 0.0 AS interpolated FROM m WHERE abs(time_index - center) <= 2"""


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.resample_linear(signals(spark, sf_dir), 9).select("recording", "frame", r6("value").alias("value"))


RESAMPLED = f"""WITH {SIGNAL}, g AS (SELECT recording, n, CAST(unnest(range(9)) AS INTEGER) AS frame FROM (SELECT recording, count(*) AS n FROM signal GROUP BY 1)),
a AS (SELECT recording, frame, n, frame * (n - 1) / 8.0 AS pos FROM g)
SELECT a.recording, frame, round(l.value + (h.value - l.value) * (pos - floor(pos)), 6) + 0.0 AS value FROM a JOIN signal l ON l.recording = a.recording AND l.sample_index = floor(pos)
JOIN signal h ON h.recording = a.recording AND h.sample_index = least(floor(pos) + 1, n - 1)"""


def busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = p.busiest_window(frames(spark, sf_dir), "bout_state", 30, ["recording"], "time_index")
    return b.select("recording", F.col("window_start").cast("int").alias("window_start"), F.col("window_sum").cast("long").alias("window_sum"))


BUSIEST = f"""WITH {WIDE}, s AS (SELECT recording, time_index, sum(bout_state) OVER w AS t, count(*) OVER w AS n FROM wide WINDOW w AS (PARTITION BY recording ORDER BY time_index ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT recording, time_index AS window_start, CAST(t AS BIGINT) AS window_sum FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t DESC, time_index) AS k FROM s WHERE n = 30) WHERE k = 1"""


def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = folds.strict_folds(frames(spark, sf_dir), 4, 6, required_gap=3)
    return f.groupBy("recording", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("time_index").alias("first"), F.max("time_index").alias("last"))


_EDGES = "e AS (SELECT recording, n, fold, CAST(round_even(fold * n / 4.0, 0) AS INTEGER) AS start, CAST(round_even((fold + 1) * n / 4.0, 0) AS INTEGER) AS stop FROM (SELECT recording, max(time_index) + 1 AS n FROM wide GROUP BY 1), (SELECT CAST(unnest(range(4)) AS INTEGER) AS fold))"
FOLD_TABLE = f"""WITH {WIDE}, {_EDGES}, r AS (SELECT recording, fold, time_index, CASE WHEN time_index >= start AND time_index < stop THEN 'test' WHEN time_index < start - 6 OR time_index >= stop + 6 THEN 'train' ELSE 'gap' END AS role FROM wide JOIN e USING (recording))
SELECT recording, fold, role, count(*) AS n, min(time_index) AS first, max(time_index) AS last FROM r GROUP BY 1, 2, 3"""


def decoding_mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frames(spark, sf_dir)
    m = folds.decoding_masks(w.select("recording", "time_index"), folds.fold_edges(w, 4, 6), (0, 1, 3), 1)
    return m.select("recording", "fold", "time_index", "role")


DECODING_MASKS = f"""WITH {WIDE}, {_EDGES}, f AS (SELECT recording, fold, time_index AS t, time_index < start - 6 OR time_index >= stop + 6 AS train, time_index >= start AND time_index < stop AS test FROM wide JOIN e USING (recording))
SELECT a.recording, a.fold, a.t AS time_index, CASE WHEN y.train AND a.train AND b.train AND c.train THEN 'train' ELSE 'test' END AS role
FROM f a JOIN f b ON b.recording = a.recording AND b.fold = a.fold AND b.t = a.t - 1 JOIN f c ON c.recording = a.recording AND c.fold = a.fold AND c.t = a.t - 3 JOIN f y ON y.recording = a.recording AND y.fold = a.fold AND y.t = a.t + 1
WHERE (y.train AND a.train AND b.train AND c.train) OR (y.test AND NOT a.train AND NOT b.train AND NOT c.train)"""


def causal_mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frames(spark, sf_dir)
    m = folds.causal_masks(w.select("recording", "time_index"), folds.fold_edges(w, 4, 6), 4, 1)
    return m.groupBy("recording", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("time_index").alias("first"), F.max("time_index").alias("last"))


CAUSAL_MASKS = f"""WITH {WIDE}, {_EDGES}, f AS (SELECT recording, fold, time_index AS t, time_index < start - 6 OR time_index >= stop + 6 AS train, time_index >= start AND time_index < stop AS test FROM wide JOIN e USING (recording)),
m AS (SELECT a.recording, a.fold, a.t, a.test AND y.test AND NOT a.train AND NOT b.train AND NOT c.train AND NOT y.train AS test, a.train AND b.train AND c.train AND y.train AS train
FROM f a JOIN f b ON b.recording = a.recording AND b.fold = a.fold AND b.t = a.t - 1 JOIN f c ON c.recording = a.recording AND c.fold = a.fold AND c.t = a.t - 2 JOIN f y ON y.recording = a.recording AND y.fold = a.fold AND y.t = a.t + 1)
SELECT recording, fold, CASE WHEN train THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(t) AS first, max(t) AS last FROM m WHERE train OR test GROUP BY 1, 2, 3"""


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = folds.blocks_in_segments(frames(spark, sf_dir).filter(F.col("level") != 3).select("recording", "time_index"), 4)
    return b.groupBy("recording", "segment", "block").agg(F.min("time_index").alias("first"), F.count(F.lit(1)).alias("n"))


SEGMENTS = f"""WITH {WIDE}, k AS (SELECT recording, time_index, time_index - row_number() OVER (PARTITION BY recording ORDER BY time_index) AS g FROM wide WHERE level <> 3),
s AS (SELECT recording, time_index, CAST(dense_rank() OVER (PARTITION BY recording ORDER BY g) - 1 AS INTEGER) AS segment, row_number() OVER (PARTITION BY recording, g ORDER BY time_index) - 1 AS place FROM k)
SELECT recording, segment, CAST(place // 4 AS INTEGER) AS block, min(time_index) AS first, count(*) AS n FROM s GROUP BY 1, 2, 3"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frames(spark, sf_dir)
    roles = folds.strict_folds(w, 4, 6)
    fits = roles.filter("role = 'train'").select(F.lit("fit_on_train").alias("operation"), "recording", "fold", "time_index")
    leaky = roles.filter("role <> 'gap'").select(F.lit("fit_on_all").alias("operation"), "recording", "fold", "time_index")
    return folds.leakage_audit(fits.unionByName(leaky), roles)


AUDIT = f"""WITH {WIDE}, {_EDGES}, r AS (SELECT recording, fold, CASE WHEN time_index >= start AND time_index < stop THEN 'test' WHEN time_index < start - 6 OR time_index >= stop + 6 THEN 'train' ELSE 'gap' END AS role FROM wide JOIN e USING (recording)),
f AS (SELECT 'fit_on_train' AS operation, * FROM r WHERE role = 'train' UNION ALL SELECT 'fit_on_all', * FROM r WHERE role <> 'gap')
SELECT operation, recording, fold, count(*) AS n_fit, count_if(role = 'test') AS n_overlap, count_if(role = 'test') = 0 AS leakage_free FROM f GROUP BY 1, 2, 3"""


def null_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null series by both strategies: each row gets the value that the hashed order of blocks, or the shift, brings to it."""
    w = frames(spark, sf_dir).select("recording", "time_index", "level")
    both = [folds.null_targets(w, "level", s, 10, 3, 20).select("recording", F.lit(s).alias("strategy"), "time_index", "null_value") for s in ("block_shuffle", "circular_shift")]
    return both[0].unionByName(both[1])


NULL_VALUES = f"""WITH {WIDE}, g AS (SELECT recording, time_index, level, row_number() OVER o - 1 AS q, CASE WHEN time_index - lag(time_index) OVER o = 1 THEN 0 ELSE 1 END AS new FROM wide WINDOW o AS (PARTITION BY recording ORDER BY time_index)),
s AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY q) AS seg, count(*) OVER (PARTITION BY recording) AS n FROM g),
b AS (SELECT *, (row_number() OVER (PARTITION BY recording, seg ORDER BY q) - 1) // 10 AS nth FROM s),
i AS (SELECT *, dense_rank() OVER (PARTITION BY recording ORDER BY seg, nth) - 1 AS block, greatest(1, least(20, n // 2)) AS low FROM b),
m AS (SELECT recording, 'block_shuffle' AS strategy, level, row_number() OVER (PARTITION BY recording ORDER BY md5('3:' || block), block, q) - 1 AS p FROM i
 UNION ALL SELECT recording, 'circular_shift', level, (q + low + CAST('0x' || substr(md5('3'), 1, 8) AS BIGINT) % (greatest(low + 1, n - low + 1) - low)) % n FROM i)
SELECT m.recording, m.strategy, g.time_index, m.level AS null_value FROM m JOIN g ON g.recording = m.recording AND g.q = m.p"""


QUERIES = {
    "impute_by_median": imputed, "cell_subset": cell_subset, "drop_bad_frames": good_frames, "bin_to_frames": binned, "first_difference": differences, "moving_average": smoothed,
    "bout_state": bouts, "behavior_targets": targets, "target_grid": grid, "lagged_design": lagged, "paired_windows": windows, "standardize_by_train": standardized,
    "interpolate_window": interpolated, "resample_linear": resampled, "busiest_window": busiest, "strict_folds": fold_table, "decoding_masks": decoding_mask_table,
    "causal_masks": causal_mask_table, "segments_and_blocks": segment_table, "leakage_audit": audit, "null_targets": null_values,
}
ORACLES = {
    "impute_by_median": IMPUTED, "cell_subset": CELL_SUBSET, "drop_bad_frames": GOOD_FRAMES, "bin_to_frames": BINNED, "first_difference": DIFFERENCES, "moving_average": SMOOTHED,
    "bout_state": BOUTS, "behavior_targets": TARGETS, "target_grid": GRID, "lagged_design": LAGGED, "paired_windows": WINDOWS, "standardize_by_train": STANDARDIZED,
    "interpolate_window": INTERPOLATED, "resample_linear": RESAMPLED, "busiest_window": BUSIEST, "strict_folds": FOLD_TABLE, "decoding_masks": DECODING_MASKS,
    "causal_masks": CAUSAL_MASKS, "segments_and_blocks": SEGMENTS, "leakage_audit": AUDIT, "null_targets": NULL_VALUES,
}
