"""Every core query against its SQL on the smallest tables."""

import pytest

from tests.oracle import assert_same
from tracewright.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LARGER = {"recording_effects"}  # its units need all nations


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    at = "/root/testdata/sf0.01" if name in LARGER else SMALL
    assert_same(QUERIES[name](spark, at), ORACLES[name], at)


def test_entry_has_every_part():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
