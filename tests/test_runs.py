import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import bss
from tracewright.sources import runs


def frames(spark, n=120, seed=0):
    r = np.random.default_rng(seed)
    x = np.stack([np.sin(np.arange(n) / 5), r.laplace(size=n), r.laplace(size=n)], axis=1) @ r.normal(size=(3, 4))
    return spark.createDataFrame([(0, t, [float(v) for v in x[t]]) for t in range(n)], "recording int, time_index int, x array<double>")


def test_a_run_comes_back_whole(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, b = spark.range(5), spark.createDataFrame([("x", [1.0])], "k string, v array<double>")
    told = runs.save_run({"a": a, "b": b}, root, "run 1", {"seed": 3})
    assert told["tables"]["a"]["rows"] == 5 and runs.read_manifest(spark, root, "run 1")["settings"] == {"seed": 3}
    back = runs.load_run(spark, root, "run 1")
    assert sorted(back) == ["a", "b"] and back["b"].collect() == b.collect() and back["a"].count() == 5
    with pytest.raises(runs.MissingTables, match="lacks c, d") as e:
        runs.load_run(spark, root, "run 1", ["a", "c", "d"])
    assert e.value.missing == ["c", "d"]


def test_a_save_that_breaks_off_leaves_the_run_before(spark, tmp_path):
    root = f"file://{tmp_path}"
    broken = spark.range(3).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        runs.save_run({"a": spark.range(2), "b": broken}, root, "r")
    with pytest.raises(runs.MissingTables, match="manifest"):
        runs.load_run(spark, root, "r")
    runs.save_run({"a": spark.range(4)}, root, "r")
    with pytest.raises(Exception, match="lost"):
        runs.save_run({"a": spark.range(9), "b": broken}, root, "r")
    assert runs.load_run(spark, root, "r")["a"].count() == 4
    runs.save_run({"a": spark.range(7)}, root, "r")
    assert runs.load_run(spark, root, "r")["a"].count() == 7
    assert len([p for p in (tmp_path / "r").iterdir() if p.is_dir()]) == 1  # what broken saves wrote is gone
    (tmp_path / "r" / runs.MANIFEST).write_text("{")
    (tmp_path / "r" / f".{runs.MANIFEST}.crc").unlink(missing_ok=True)
    with pytest.raises(runs.MissingTables):
        runs.load_run(spark, root, "r")


def test_legacy_places_are_looked_through(spark, tmp_path):
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    spark.range(3).write.parquet(f"{old}/r/a")
    assert runs.load_run(spark, new, "r", ["a"], [f"file://{tmp_path}/none", old])["a"].count() == 3
    with pytest.raises(runs.MissingTables, match="lacks b"):
        runs.load_run(spark, new, "r", ["a", "b"], [old])
    runs.save_run({"a": spark.range(8)}, new, "r")
    assert runs.load_run(spark, new, "r", ["a"], [old])["a"].count() == 8


def test_cleaned_frames_are_rebuilt_where_only_the_decomposition_was_saved(spark, tmp_path):
    root, df = f"file://{tmp_path}", frames(spark)
    models = bss.fit_bss(df, bss.fit_specs(("sobi",), (3,)))
    selection = models.select("recording", "spec", "component", F.lit("kept").alias("name")).filter("component < 2")
    cleaned = bss.rebuilt(df.withColumn("role", F.lit("all")), models, selection, ("recording",))
    runs.save_decomposition(models, selection, root, "with", cleaned)
    runs.save_decomposition(models, selection, root, "without")
    rows = lambda d: np.array([r["x"] for r in d.orderBy("time_index").collect()])
    assert np.allclose(rows(runs.load_cleaned(spark, df, root, "with")), rows(cleaned))
    assert np.allclose(rows(runs.load_cleaned(spark, df, root, "without")), rows(cleaned))
    both = runs.raw_and_cleaned(spark, df, root, ["with", "without"])
    assert {r["variant"]: r["count"] for r in both.groupBy("variant").count().collect()} == {"raw": 120, "with_cleaned": 120, "without_cleaned": 120}
    with pytest.raises(runs.MissingTables, match="cleaned"):
        runs.raw_and_cleaned(spark, df, root, ["without"], require_saved=True)
    with pytest.raises(runs.MissingTables, match="models, selection"):
        runs.load_cleaned(spark, df, root, "nothing")


def test_selections_as_json(spark, tmp_path):
    root = f"file://{tmp_path}"
    runs.save_selection(spark, root, "r", [2, 0], [1], 4)
    runs.save_selection(spark, root, "r", [0], [1, 2], 4)
    assert runs.load_selection(spark, root, "r") == {"components": 4, "keep": [0], "reject": [1, 2]}
    for keep, reject in (([0], [0]), ([4], []), ([-1], [])):
        with pytest.raises(ValueError):
            runs.save_selection(spark, root, "r", keep, reject, 4)
    with pytest.raises(FileNotFoundError):
        runs.load_selection(spark, root, "other")
