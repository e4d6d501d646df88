import pytest

from convexus import catalog
from tests import duck


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, sf_dir, connection, name):
    duck.same(catalog.QUERIES[name](spark, sf_dir), connection, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
