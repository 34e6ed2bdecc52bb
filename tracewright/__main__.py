"""python -m tracewright --config FILE --data DIR --output DIR: a full evaluation of the recordings in DIR."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .pipeline.evaluation import EvaluationConfig, manifest, run_evaluation, write_tables
from .scratch import ship
from .sources.catalog import output_path, provenance, write_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    p.add_argument("--data", required=True, help="folder with frames and targets as Parquet")
    p.add_argument("--output", required=True)
    p.add_argument("--config", help="JSON settings")
    p.add_argument("--recording", action="append", help="only these recordings")
    p.add_argument("--all-datasets", action="store_true", help="all recordings, which is also the default")
    p.add_argument("--list-datasets", action="store_true")
    p.add_argument("--sample-rate", type=float, help="frames a second, where the settings don't say")
    p.add_argument("--provenance-only", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    provenance(spark, a.data).write.mode("overwrite").parquet(output_path(a.output, "provenance"))
    if a.provenance_only:
        return 0
    frames, targets = spark.read.parquet(f"{a.data}/frames"), spark.read.parquet(f"{a.data}/targets")
    if a.list_datasets:
        for r in frames.groupBy("recording").count().orderBy("recording").toLocalIterator():
            print(r["recording"], r["count"])
        return 0
    if a.recording and a.all_datasets:
        raise ValueError("give --recording or --all-datasets, not both")
    if a.recording:
        all_frames, frames = frames, frames.filter(F.col("recording").cast("string").isin(a.recording))
        found = {r[0] for r in frames.select(F.col("recording").cast("string")).distinct().collect()}
        if unknown := sorted(set(a.recording) - found):
            known = [r[0] for r in all_frames.select(F.col("recording").cast("string").alias("r")).distinct().orderBy("r").limit(100).collect()]
            raise KeyError(f"unknown recordings: {unknown}; there are {known}")
    rate = {"sample_rate_hz": a.sample_rate} if a.sample_rate else {}
    config = EvaluationConfig.from_json(a.config, **rate) if a.config else EvaluationConfig(**rate)
    tables = run_evaluation(frames, targets, config)
    write_tables(tables, output_path(a.output, "tables"))
    write_json(spark, {"manifest": manifest(spark, tables, config)}, output_path(a.output, "manifest"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
