"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from oracles import all_oracles
from sitelore.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SQL = all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got, want, error = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    spark.catalog.clearCache()
    assert error is None, error
    assert got == want


def test_the_check_sees_a_difference(spark, con):
    wrong = SQL["cost_flat"].replace("0.05", "0.06")
    assert compare(spark, con, SF, "cost_flat", QUERIES["cost_flat"], wrong)[2]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
