"""Every job with oracle SQL must equal DuckDB on the sf0.01 tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_oracle_has_a_job():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], SQL[name], SF001)
    assert res["cols_match"], res
    assert res["spark_rows"] == res["duck_rows"], res
    assert res["match"], res
