"""Every registered core query against DuckDB on the smallest tables."""

import pytest
from compare import connect, same

from amberweave import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    same(catalog.queries()[name](spark, sf), con, catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
