"""Queries over recordings against their SQL where the last recording has few frames."""

from pathlib import Path

import duckdb
import pytest

from tests.oracle import TABLES, assert_same
from tracewright.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """A folder like SMALL with the first vectors, so that the second recording has that many frames, without those of numbers in `gone`."""

    def make(frames: int, gone: str = "false") -> str:
        at = tmp_path_factory.mktemp("short")
        for t in TABLES:
            Path(at, f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet") if t != "embeddings" else None
        duckdb.sql(f"COPY (SELECT * FROM '{SMALL}/embeddings.parquet' WHERE vec_id < 250 + {frames} AND NOT ({gone})) TO '{at}/embeddings.parquet'")
        return str(at)

    return make


@pytest.mark.parametrize("name", ["component_spectra", "spectral_preservation"])
@pytest.mark.parametrize(("frames", "gone"), [(100, "false"), (33, "false"), (3, "false"), (1, "false"), (120, "vec_id IN (40, 290, 292)")])
def test_spectra_of_few_frames_match_sql(spark, cut, name, frames, gone):
    at = cut(frames, gone)
    assert_same(QUERIES[name](spark, at), ORACLES[name], at)


@pytest.mark.parametrize("frames", [64, 32, 9, 2, 1])
@pytest.mark.parametrize("name", ["whitening_by_chunks", "energy_shares"])
def test_ranks_of_few_frames_match_sql(spark, cut, name, frames):
    at = cut(frames)
    assert_same(QUERIES[name](spark, at), ORACLES[name], at)


@pytest.mark.parametrize(("frames", "gone"), [(1, "false"), (2, "false"), (9, "vec_id IN (40, 256)")])
def test_round_trip_of_few_frames_matches_sql(spark, cut, frames, gone):
    at = cut(frames, gone)
    assert_same(QUERIES["bss_round_trip"](spark, at), ORACLES["bss_round_trip"], at)


def test_round_trip_of_repeated_frames_matches_sql(spark, cut, tmp_path):
    """The second recording has seven different frames among 20, the third twice the same."""
    at = cut(20)
    for t in TABLES:
        Path(tmp_path, f"{t}.parquet").symlink_to(f"{at}/{t}.parquet") if t != "embeddings" else None
    source = "CASE WHEN vec_id < 250 THEN vec_id WHEN vec_id < 270 THEN 250 + vec_id % 7 ELSE 3 END"
    ids = "SELECT unnest(range(270)) AS vec_id UNION ALL SELECT unnest([500, 501])"
    duckdb.sql(f"COPY (SELECT i.vec_id, e.* EXCLUDE (vec_id) FROM ({ids}) i JOIN '{SMALL}/embeddings.parquet' e ON e.vec_id = {source.replace('vec_id', 'i.vec_id')}) TO '{tmp_path}/embeddings.parquet'")
    assert_same(QUERIES["bss_round_trip"](spark, str(tmp_path)), ORACLES["bss_round_trip"], str(tmp_path))
