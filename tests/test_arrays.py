import warnings

import numpy as np
import pytest

from tracewright.sources import arrays


def values(df):
    return [r["x"] for r in df.orderBy("time_index").collect()]


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f8", "<f4", ">i2", "|b1"])
def test_frames_of_every_order_and_type(spark, tmp_path, order, dtype):
    a = (np.arange(300).reshape(3, 100) % 7).astype(dtype)
    np.save(tmp_path / "a.npy", np.asarray(a, order=order))
    df = arrays.read_frames(spark, [str(tmp_path / "a.npy")], partition_bytes=8 * 3 * 17)
    assert df.rdd.getNumPartitions() == 6 and values(df) == a.T.astype(float).tolist()
    by_frames = arrays.read_frames(spark, [str(tmp_path / "a.npy")], "frames_by_neurons")
    assert values(by_frames) == a.astype(float).tolist()


def test_orientation_follows_the_expected_frames(tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((4, 9)))
    np.save(tmp_path / "b.npy", np.zeros((5, 5)))
    path = str(tmp_path / "a.npy")
    assert arrays.header_of(path).frames == 9 and arrays.header_of(path, expected_frames=4).frames == 4
    assert arrays.header_of(path, expected_frames=7).frames == 9 and arrays.header_of(str(tmp_path / "b.npy")).time_first


def test_other_files_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([[{}]], dtype=object), allow_pickle=True)
    np.save(tmp_path / "c.npy", np.zeros((2, 2, 2)))
    (tmp_path / "t.npy").write_text("text")
    np.save(tmp_path / "s.npy", np.zeros((50, 20)))
    with open(tmp_path / "s.npy", "r+b") as f:
        f.truncate(1000)
    for name, say in (("o", "refused"), ("c", "3 dimensions"), ("t", "not a .npy")):
        with pytest.raises(ValueError, match=say):
            arrays.header_of(str(tmp_path / f"{name}.npy"))
    with pytest.raises(Exception, match="ends before"):
        arrays.read_frames(spark, [str(tmp_path / "s.npy")]).collect()
    with pytest.raises(ValueError):
        arrays.header_of(str(tmp_path / "c.npy"), "sideways")
    assert arrays.read_frames(spark, []).count() == 0


def save(path, a):
    path.parent.mkdir(parents=True, exist_ok=True)
    np.save(path, a)


def test_five_layouts_and_another_shape(spark, tmp_path):
    root = tmp_path / "clean"
    raw = np.random.default_rng(0).normal(size=(3, 40))
    save(tmp_path / "raw.npy", raw)
    places = {
        "sobi/incremental/low_03/cleaned/cleaned_a.npy": "sobi/low_03/cleaned_a", "jade/cleaned_variants/cluster_keep_top_04/cleaned/cleaned_a.npy": "jade/keep_top_04/cleaned_a",
        "infomax/cleaned/cleaned_b.npy": "infomax/cleaned_b", "fastica/rec_1.x/cleaned_c.npy": "fastica/cleaned_c", "ica/cleaned_d.npy": "ica/cleaned_d",
    }
    for k, place in enumerate(places):
        save(root / place, raw * (k + 2) if k % 2 else (raw * (k + 2)).T)
    save(root / "ica/other_recording/cleaned_e.npy", raw)
    save(root / "ica/deeper/and/deeper/cleaned_f.npy", raw)
    save(root / "ica/cleaned/cleaned_short.npy", raw[:, :30])
    save(root / "ica/cleaned/notes_g.npy", raw)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        df = arrays.load_variants(spark, str(tmp_path / "raw.npy"), str(root), "rec_1.x", partition_bytes=500)
    assert any("cleaned_short" in str(w.message) for w in said)
    assert {r["variant"] for r in df.select("variant").distinct().collect()} == {"raw", *places.values()}
    for k, name in enumerate(places.values()):
        assert values(df.filter(df["variant"] == name)) == (raw * (k + 2)).T.tolist()


def test_raw_override_and_strict_folder(spark, tmp_path):
    raw = np.arange(20.0).reshape(2, 10)
    save(tmp_path / "cleaned_a.npy", raw + 1)
    filtered = spark.createDataFrame([(t, [float(v) for v in raw[:, t] * 2]) for t in range(10)], "time_index int, x array<double>")
    df = arrays.load_variants(spark, filtered, str(tmp_path), "r", in_layouts=False)
    assert values(df.filter("variant = 'raw'")) == (raw * 2).T.tolist() and values(df.filter("variant = 'cleaned_a'")) == (raw + 1).T.tolist()
    save(tmp_path / "cleaned_b.npy", raw[:, :7])
    with pytest.raises(ValueError, match="7 frames of 2 series"):
        arrays.load_variants(spark, filtered, str(tmp_path), "r", in_layouts=False)
