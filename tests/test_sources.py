import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import graphs
from tracewright.sources import catalog
from tracewright.streaming.frames import binned_stream


def test_npy_catalog_and_rates(spark, tmp_path):
    d = tmp_path / "220119_F2_run1"
    d.mkdir()
    a = np.arange(12.0).reshape(3, 4)
    np.save(d / "220119_F2_run1_cells_fluorescence_signals.npy", a)
    np.save(d / "old_cells_fluorescence_signals.npy", a)
    (d / "x_analysis_info.json").write_text(json.dumps({"frameRateSCAPE": 5.0}))
    (d / "y_analysis_info.json").write_text("no json")
    best = catalog.best_files(catalog.discover_recordings(spark, str(tmp_path)), "fluorescence").collect()
    assert len(best) == 1 and best[0]["name"].startswith("220119")
    x = catalog.read_npy(spark, str(tmp_path), "2201*.npy").orderBy("time_index").collect()
    assert [r["x"] for r in x] == a.T.tolist()
    assert sorted(r["sample_rate_hz"] for r in catalog.frame_rates(spark, str(tmp_path), 4.0).collect()) == [4.0, 5.0]
    assert catalog.provenance(spark, str(tmp_path)).filter("is_duplicate").count() == 2


def test_paths_stay_inside():
    assert catalog.output_path("/o", "a b", "c/d") == "/o/a_b/c_d"
    with pytest.raises(ValueError):
        catalog.output_path("/o", "..")


def test_variant_sink_replaces_its_partitions_only(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, v int")
    catalog.write_variants(df, str(tmp_path / "v"))
    catalog.write_variants(spark.createDataFrame([("b", 3)], "variant string, v int"), str(tmp_path / "v"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v")).select("variant", "v").collect())) == [("a", 1), ("b", 3)]


def test_stacking_overwrites_identity_columns(spark):
    a = spark.createDataFrame([("wrong", 1)], "recording string, x int")
    b = spark.createDataFrame([(2.0,)], "y double")
    rows = {r["recording"]: (r["x"], r["y"]) for r in catalog.stacked({"r1": a, "r2": b}).collect()}
    assert rows == {"r1": (1, None), "r2": (None, 2.0)}


def test_graph_upsert(spark):
    old = spark.createDataFrame([("a", 0, 1)], "variant string, source int, target int")
    new = spark.createDataFrame([("a", 1, 0)], "variant string, source int, target int")
    assert [tuple(r) for r in graphs.upsert_edges(old, new).collect()] == [("a", 1, 0)]
    with pytest.raises(FileExistsError):
        graphs.upsert_edges(old, new, replace=False)


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    rows = binned_stream(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001"), 86400)
    q = rows.writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    batch = binned_stream(spark.read.parquet(src), 86400)
    key = lambda df: sorted((r["user_id"], r["start"], r["n"]) for r in df.select("user_id", "start", F.col("n")).collect())
    assert key(spark.table("bins")) == key(batch)


def test_written_tables_can_be_forgotten(spark):
    from pathlib import Path

    from tracewright.scratch import forget, written

    table, path = written(spark.range(5), "t")
    assert table.count() == 5 and Path(path.removeprefix("file://")).exists()
    forget(spark, path)
    assert not Path(path.removeprefix("file://")).exists()
