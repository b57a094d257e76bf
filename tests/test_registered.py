"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registry
import oracle_check
from skyledger.registry.oracle import all_oracles
from skyledger.registry.queries import all_queries

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def tables(small):
    return oracle_check.connect(small)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, tables, name):
    assert oracle_check.difference(QUERIES[name](spark, small), tables, ORACLES[name]) is None


def test_entry_is_the_timeline(spark):
    rows = registry.entry(spark)
    assert rows.columns == ["label", "real_pm25"]
    assert rows.count() > 0
