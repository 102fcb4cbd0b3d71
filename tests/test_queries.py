"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare
from workload.base import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    result = compare(spark, name, SF, con)
    assert result.startswith("ok") and "<>" not in result, result


def test_every_query_has_rows_or_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.QUERIES) - set(entry.ORACLES) == {
        "synthetic_lineitem", "tstr", "mia_forest", "evaluate_all", "epsilon_sweep"
    }


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) >= 7 and all(r.orphans == 0 for r in rows)
