"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    result = compare(spark, con, name, entry.queries()[name], SQL[name], SF)
    assert result.startswith("ok"), result


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
