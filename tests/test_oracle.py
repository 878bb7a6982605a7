"""Every registered query against its SQL, value by value."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from pagegrid.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"tuning_report"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
