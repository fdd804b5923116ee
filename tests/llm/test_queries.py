import pytest
from cadenza.llm import queries

from ..oracle import same, views


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), views(data), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_whole_tables(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
