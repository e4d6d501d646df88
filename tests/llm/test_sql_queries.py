import pytest

from convexus.llm import queries
from tests import duck


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    duck.same(queries.QUERIES[name](spark, sf_dir), duck.connect(sf_dir), queries.SQL[name])
