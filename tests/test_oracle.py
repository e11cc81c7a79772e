"""Every catalog query that has SQL gives the same rows in a second engine."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    check_oracle.tables(c, SF)
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    ok, message = check_oracle.compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
