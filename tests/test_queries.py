"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from pagetide.plans.queries import QUERIES as OWN

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_sql():
    """All queries but text operators that SQL cannot express; those are tested against brute force."""
    assert set(OWN) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, name, QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    records = contract.entry(spark)
    assert records.columns[:3] == ["url", "title", "meta_description"] and records.count() > 0
