"""Every registered netlist query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from compared import of_duckdb, of_spark
from wireloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_duckdb(SF, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
