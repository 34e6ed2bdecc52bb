"""Saved runs: the tables of one run under a manifest that is written last, so that a run is either there whole or not at all.

A run's tables lie in a folder of their own for each time it is saved; the manifest names that folder and its tables and is put in place by one
rename. A save that breaks off leaves the manifest before it and thus the run before it; what it had written is deleted by the next save.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bss
from .catalog import output_path

MANIFEST = "manifest.json"


class MissingTables(FileNotFoundError):
    """What a loader looked for and didn't find."""

    def __init__(self, name: str, missing: Sequence[str], places: Sequence[str]):
        self.missing = list(missing)
        super().__init__(f"run {name!r} lacks {', '.join(self.missing)}; looked in {', '.join(places)}")


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it there."""
    system, where = _system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(aside, where):  # some file systems don't rename onto a file
        system.delete(where, False)
        if not system.rename(aside, where):
            raise OSError(f"could not put {path} in place")


def _text(spark: SparkSession, path: str) -> str | None:
    system, where = _system(spark, path)
    if not system.exists(where):
        return None
    return spark.read.option("wholetext", "true").text(path).first()[0]


def read_manifest(spark: SparkSession, root: str, name: str) -> dict | None:
    """The run's manifest; None where there is none or it can't be read."""
    text = _text(spark, f"{output_path(root, name)}/{MANIFEST}")
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, dict) and isinstance(found.get("tables"), dict) else None


def save_run(tables: Mapping[str, DataFrame], root: str, name: str, settings: Mapping | None = None) -> dict:
    """Writes all tables, then the manifest; returns it. Folders of earlier or broken saves go once it is in place."""
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    base, part = output_path(root, name), uuid.uuid4().hex
    told = {}
    for table, df in tables.items():
        path = output_path(f"{base}/{part}", table)
        df.write.parquet(path)
        told[table] = {"path": path.removeprefix(f"{base}/"), "columns": df.columns, "rows": spark.read.schema(df.schema).parquet(path).count()}
    manifest = {"run": name, "folder": part, "tables": told, "settings": dict(settings or {})}
    _replace(spark, f"{base}/{MANIFEST}", json.dumps(manifest, sort_keys=True, default=str))
    system, where = _system(spark, base)
    for status in system.listStatus(where):
        if status.isDirectory() and status.getPath().getName() != part:
            system.delete(status.getPath(), True)
    return manifest


def load_run(spark: SparkSession, root: str, name: str, wanted: Sequence[str] | None = None, legacy_roots: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The run's tables (or the wanted ones). Legacy roots, where each table is a folder <root>/<name>/<table> without a manifest, are looked through in
    turn if there is no run under root. Raises MissingTables with all that is missing in the place where most was found.
    """
    places, least = [output_path(root, name)], None
    manifest = read_manifest(spark, root, name)
    if manifest is not None:
        tables, missing = {}, [t for t in wanted or () if t not in manifest["tables"]]
        for table in wanted or manifest["tables"]:
            if table in manifest["tables"]:
                system, where = _system(spark, f"{places[0]}/{manifest['tables'][table]['path']}")
                if system.exists(where):
                    tables[table] = spark.read.parquet(where.toString())
                else:
                    missing.append(table)
        if not missing:
            return tables
        least = missing
    for legacy in legacy_roots if manifest is None else ():
        base = output_path(legacy, name)
        places.append(base)
        system, where = _system(spark, base)
        there = {s.getPath().getName(): s.getPath().toString() for s in system.listStatus(where) if s.isDirectory()} if system.exists(where) else {}
        missing = [t for t in wanted or () if t not in there]
        if there and not missing:
            return {t: spark.read.parquet(there[t]) for t in wanted or sorted(there)}
        if there and (least is None or len(missing) < len(least)):
            least = missing
    raise MissingTables(name, least if least is not None else list(wanted or ("its manifest",)), places)


#: Tables of a saved decomposition; the selection names the components that stay.
DECOMPOSITION = ("models", "selection")


def save_decomposition(models: DataFrame, selection: DataFrame, root: str, name: str, cleaned: DataFrame | None = None, settings: Mapping | None = None) -> dict:
    """models of fit_bss, selection(keys, spec, component, name) and, if it is to be kept, the frames rebuilt from them."""
    return save_run({"models": models, "selection": selection} | ({} if cleaned is None else {"cleaned": cleaned}), root, name, settings)


def load_cleaned(spark: SparkSession, frames: DataFrame, root: str, name: str, keys: Sequence[str] = ("recording",), legacy_roots: Sequence[str] = ()) -> DataFrame:
    """The saved cleaned frames, or where only the decomposition was saved the same rebuilt from frames(keys, time_index, x)."""
    try:
        return load_run(spark, root, name, ["cleaned"], legacy_roots)["cleaned"]
    except MissingTables:
        run = load_run(spark, root, name, DECOMPOSITION, legacy_roots)
        rows = frames if "role" in frames.columns else frames.withColumn("role", F.lit("all"))
        return bss.rebuilt(rows, run["models"], run["selection"], keys)


def raw_and_cleaned(spark: SparkSession, frames: DataFrame, root: str, names: Sequence[str], keys: Sequence[str] = ("recording",), require_saved: bool = False, legacy_roots: Sequence[str] = ()) -> DataFrame:
    """keys, variant, time_index and x: raw and the cleaned frames of each run, for graphs. require_saved: runs without saved frames raise."""
    out = frames.select(*keys, F.lit("raw").alias("variant"), "time_index", "x")
    for name in names:
        own = load_run(spark, root, name, ["cleaned"], legacy_roots)["cleaned"] if require_saved else load_cleaned(spark, frames, root, name, keys, legacy_roots)
        out = out.unionByName(own.select(*keys, F.lit(f"{name}_cleaned").alias("variant"), "time_index", "x"))
    return out


def save_selection(spark: SparkSession, root: str, name: str, keep: Sequence[int], reject: Sequence[int], components: int) -> None:
    """A selection of components as JSON, put in place at once; keep and reject may not overlap or leave the range."""
    keep, reject = sorted(set(map(int, keep))), sorted(set(map(int, reject)))
    if set(keep) & set(reject) or any(not 0 <= c < components for c in keep + reject):
        raise ValueError("components are kept or rejected, and lie in the range of the decomposition")
    _replace(spark, f"{output_path(root, name)}.selection.json", json.dumps({"components": components, "keep": keep, "reject": reject}, sort_keys=True))


def load_selection(spark: SparkSession, root: str, name: str) -> dict:
    text = _text(spark, path := f"{output_path(root, name)}.selection.json")
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)
