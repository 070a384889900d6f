"""Every registered query against its DuckDB oracle (rows, columns, values).

Runs on STOCKLINE_TEST_SF (default sf0.001); the driver runs the same check at
sf0.01, and ``python tools/oracle_check.py /root/testdata/sf0.01`` does too.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck_connection
from stockline.plans import catalog, oracle

KEYS = sorted(catalog.queries())


def test_every_query_has_an_oracle():
    assert set(KEYS) == set(oracle.oracle_queries())
    assert set(KEYS) <= set(entry.queries()) and set(KEYS) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "stockout_risk" in df.columns


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connection(sf_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_dir, duck, key):
    result = compare(entry.queries()[key](spark, sf_dir), entry.oracle_sql()[key], duck)
    assert result["columns_match"], (result["spark_cols"], result["oracle_cols"])
    assert result["spark_rows"] == result["oracle_rows"]
    assert result["values_match"], result["first_diff"]
