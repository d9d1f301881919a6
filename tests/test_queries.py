import pytest
from oracle import assert_same, connect

import __spark_entry__ as entry
from lumenseek.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert_same(spark, con, catalog.queries()[name], SQL[name], sf_dir)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_registered_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
