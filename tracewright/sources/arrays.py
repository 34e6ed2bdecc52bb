"""Arrays of numbers (.npy) as a Spark data source that reads byte ranges, and the variants of a recording that lie in the known folder layouts.

A file's header is read once, on the driver; each partition then reads its own frames only, so a file may be larger than a partition or a row. Paths
are URIs that pyarrow can open (local and mounted folders, s3, gs, abfs, hdfs).
"""

from __future__ import annotations

import struct
import warnings
from ast import literal_eval
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES_SCHEMA = "path string, time_index long, x array<double>"


@dataclass(frozen=True)
class ArrayFile:
    """What a header says: where the values start, their type, the shape in order of storage and which stored axis is time."""

    path: str
    offset: int
    dtype: str
    shape: tuple[int, int]
    time_first: bool

    @property
    def frames(self) -> int:
        return self.shape[0 if self.time_first else 1]

    @property
    def series(self) -> int:
        return self.shape[1 if self.time_first else 0]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def header_of(path: str, orientation: str = "auto", expected_frames: int | None = None) -> ArrayFile:
    """Reads the header of a 2-D array. orientation: neurons_by_frames, frames_by_neurons, or auto: the axis of expected_frames if just one has
    that length, else the longer one is time (the first of equal ones).
    """
    system, name = _open(path)
    with system.open_input_file(name) as f:
        start = f.read(8)
        if len(start) < 8 or start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path}: not a .npy file")
        size = struct.unpack("<H", f.read(2))[0] if start[6] == 1 else struct.unpack("<I", f.read(4))[0]
        offset = f.tell() + size
        told = literal_eval(f.read(size).decode("latin1" if start[6] < 3 else "utf-8"))
    dtype, shape = np.dtype(told["descr"]), tuple(told["shape"])
    if dtype.kind not in "fiub":
        raise ValueError(f"{path}: values of type {dtype} are refused")
    if len(shape) != 2:
        raise ValueError(f"{path}: an array of {len(shape)} dimensions")
    if orientation == "auto":
        fits = [n == expected_frames for n in shape]
        time_axis = fits.index(True) if sum(fits) == 1 else int(shape[1] > shape[0])
    elif orientation in ("neurons_by_frames", "frames_by_neurons"):
        time_axis = int(orientation == "neurons_by_frames")
    else:
        raise ValueError(f"unknown orientation {orientation!r}")
    stored = shape[::-1] if told["fortran_order"] else shape
    return ArrayFile(path, offset, dtype.str, stored, (time_axis == 0) != bool(told["fortran_order"]))


def frames_of(file: ArrayFile, start: int, stop: int) -> np.ndarray:
    """Frames start .. stop - 1 (time x series): one range of bytes, or one for each series where series are stored one after the other."""
    dtype = np.dtype(file.dtype)
    system, name = _open(file.path)

    def values(f: pa.NativeFile, at: int, n: int) -> np.ndarray:
        raw = f.read_at(n * dtype.itemsize, file.offset + at * dtype.itemsize)
        if len(raw) < n * dtype.itemsize:
            raise ValueError(f"{file.path}: ends before its last value")
        return np.frombuffer(raw, dtype)

    with system.open_input_file(name) as f:
        if file.time_first:
            return values(f, start * file.series, (stop - start) * file.series).reshape(-1, file.series).astype(float)
        return np.stack([values(f, s * file.frames + start, stop - start) for s in range(file.series)], axis=1).astype(float) if file.series else np.zeros((stop - start, 0))


@dataclass
class _Frames(InputPartition):
    file: ArrayFile
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.orientation, self.expected = options.get("orientation", "auto"), options.get("expectedFrames")
        self.bytes = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            file = header_of(path, self.orientation, int(self.expected) if self.expected else None)
            step = max(1, self.bytes // max(1, 8 * file.series))
            out += [_Frames(file, at, min(at + step, file.frames)) for at in range(0, file.frames, step)]
        return out

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        step = max(1, (4 << 20) // max(1, 8 * partition.file.series))
        for at in range(partition.start, partition.stop, step):
            x = frames_of(partition.file, at, min(at + step, partition.stop))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.file.path] * len(x), pa.string()), pa.array(np.arange(at, at + len(x))), lists], ["path", "time_index", "x"])


class NpySource(DataSource):
    """Format npy_frames. Options: paths (one a line), orientation, expectedFrames, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return FRAMES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options) | {"partitionBytes": self.options.get("partitionBytes", 64 << 20), "expectedFrames": self.options.get("expectedFrames")})


def read_frames(spark: SparkSession, paths: Sequence[str], orientation: str = "auto", expected_frames: int | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """path, time_index and x of the frames of all files, in partitions of about partition_bytes."""
    if not paths:
        return spark.createDataFrame([], FRAMES_SCHEMA)
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy_frames").option("paths", "\n".join(paths)).option("orientation", orientation).option("partitionBytes", partition_bytes)
    return (reader if expected_frames is None else reader.option("expectedFrames", expected_frames)).load()


#: The layouts of cleaned arrays below their root, first match wins; groups are the method, a selection (if any) and the file's stem.
LAYOUTS = (
    ("incremental", r"^([^/]+)/incremental/([^/]+)/cleaned/([^/]+)\.npy$"),
    ("cleaned_variants", r"^([^/]+)/cleaned_variants/(?:cluster_)?([^/]+)/cleaned/([^/]+)\.npy$"),
    ("cleaned", r"^([^/]+)()/cleaned/([^/]+)\.npy$"),
    ("recording", r"^([^/]+)()/{recording}/([^/]+)\.npy$"),
    ("method", r"^([^/]+)()/([^/]+)\.npy$"),
)


def layout_of(below: Column, recording: str) -> tuple[Column, Column]:
    """Layout and variant name (method, selection if any, stem) of a path below the root of cleaned arrays; NULL where no layout fits."""
    layout, variant = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(LAYOUTS):
        quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in recording)
        regex = pattern.replace("{recording}", quoted)
        fits = below.rlike(regex)
        parts = F.array(*(F.regexp_extract(below, regex, i) for i in (1, 2, 3)))
        layout = F.when(fits, F.lit(name)).otherwise(layout)
        variant = F.when(fits, F.array_join(F.filter(parts, lambda p: p != ""), "/")).otherwise(variant)
    return layout, variant


def cleaned_files(spark: SparkSession, root: str, recording: str, name_like: str = "cleaned_*.npy") -> DataFrame:
    """path, layout and variant of the cleaned arrays below root whose place is one of LAYOUTS; other recordings' folders are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_like).load(root).select("path")
    plain = lambda p: F.regexp_replace(p, r"^[A-Za-z0-9]+:/*", "/")
    below = F.substring(plain(F.col("path")), F.length(plain(F.lit(root.rstrip("/")))) + 2, F.length("path"))
    layout, variant = layout_of(below, recording)
    return files.select("path", layout.alias("layout"), variant.alias("variant")).filter("variant IS NOT NULL")


def load_variants(
    spark: SparkSession, raw: str | DataFrame, cleaned_root: str, recording: str, name_like: str = "cleaned_*.npy", in_layouts: bool = True, partition_bytes: int = 64 << 20,
) -> DataFrame:
    """recording, variant, time_index and x of the raw array (a path, or frames(time_index, x) that take its place) and its cleaned arrays, each
    turned so that time has the raw array's length.

    in_layouts: cleaned arrays lie in one of LAYOUTS below cleaned_root, and those of another shape are left out with a warning. Otherwise they lie
    in cleaned_root itself, and another shape raises an error.
    """
    if isinstance(raw, str):
        file = header_of(raw)
        shape, rows = (file.frames, file.series), read_frames(spark, [raw], partition_bytes=partition_bytes)
    else:
        found = raw.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        shape, rows = (found[0], found[1]), raw.withColumn("path", F.lit(None).cast("string"))
    if in_layouts:
        files = {r["path"]: r["variant"] for r in cleaned_files(spark, cleaned_root, recording, name_like).collect()}  # a row for each file
    else:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", name_like).load(cleaned_root).select("path").collect()
        files = {r["path"]: r["path"].rsplit("/", 1)[1].removesuffix(".npy") for r in listed}
    kept = []
    for path in sorted(files):
        own = header_of(path, expected_frames=shape[0])
        if (own.frames, own.series) == shape:
            kept.append(path)
        elif in_layouts:
            warnings.warn(f"left out {path}: {own.frames} frames of {own.series} series, the raw array has {shape[0]} of {shape[1]}", RuntimeWarning, stacklevel=2)
        else:
            raise ValueError(f"{path} has {own.frames} frames of {own.series} series, the raw array {shape[0]} of {shape[1]}")
    out = rows.select(F.lit(recording).alias("recording"), F.lit("raw").alias("variant"), F.col("time_index").cast("int").alias("time_index"), "x")
    if kept:
        named = F.create_map(*(F.lit(v) for p in kept for v in (p, files[p])))
        more = read_frames(spark, kept, expected_frames=shape[0], partition_bytes=partition_bytes)
        out = out.unionByName(more.select(F.lit(recording).alias("recording"), named[F.col("path")].alias("variant"), F.col("time_index").cast("int").alias("time_index"), "x"))
    return out
