import pytest
from pyspark.sql import functions as F

from tracewright.sources import nested

SCHEMA = "Fish int, Trace double, fluo_type string, n_cells int, fluo array<array<double>>, mid int"


def table(spark):
    rows = [(f, float(t), kind, 2, [[float(f), float(t), 1.0], [2.0, 3.0, float(len(kind))]], 1 + f) for f in range(4) for t in range(3) for kind in ("Soma", "NEURITE")]
    return spark.createDataFrame([*rows, (1, 0.0, "soma", 2, [[9.0, 9.0], [9.0, 9.0]], None)], SCHEMA)


def test_catalog_has_each_panel_once_and_in_order(spark):
    got = [tuple(r) for r in nested.nested_catalog(table(spark)).collect()]
    assert got == [(f, float(t), kind, 2) for f in range(4) for t in range(3) for kind in ("neurite", "soma")]
    with pytest.raises(ValueError, match="fluo_type, n_cells"):
        nested.nested_catalog(table(spark).drop("fluo_type", "n_cells"))


def test_one_row_is_unnested(spark):
    got = nested.nested_frames(table(spark), 2, 1.0, "neurITE").orderBy("time_index").collect()
    assert [(r["time_index"], r["x"]) for r in got] == [(0, [2.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 7.0])]
    again = {str(nested.nested_frames(table(spark).repartition(n), 1, 0.0, "soma").orderBy("time_index").collect()) for n in (1, 3)}
    assert len(again) == 1
    with pytest.raises(KeyError, match=r"\(0, 0.0, neurite\), \(0, 0.0, soma\)"):
        nested.nested_frames(table(spark), 7, 1.0, "soma")
    ragged = spark.createDataFrame([(1, 1.0, "a", 2, [[1.0], [1.0, 2.0]], 1), (2, 1.0, "a", 0, [], 1)], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        nested.nested_frames(ragged, 1, 1.0, "a").collect()
    assert nested.nested_frames(ragged, 2, 1.0, "a").count() == 0


def test_lookup_reaches_the_scan(spark, tmp_path):
    table(spark).orderBy("Fish", "Trace").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).filter(nested._is(2, 1.0, "soma")).select("fluo")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Fish,2)" in plan and "EqualTo(Trace,1.0)" in plan and "n_cells" not in plan.split("ReadSchema")[1]


def test_split_points(spark):
    assert nested.split_point(table(spark), 3, 0.0) == 4
    assert nested.split_point(table(spark), 1, 0.0) == 2  # nulls don't count
    with pytest.raises(KeyError, match="no mid"):
        nested.split_point(table(spark), 8, 0.0)
    with pytest.raises(KeyError, match="several"):
        nested.split_point(table(spark).withColumn("mid", F.col("n_cells") + F.length("fluo_type")), 1, 0.0)
