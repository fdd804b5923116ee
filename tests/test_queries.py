import pytest
from cadenza import catalog

from .oracle import same, views


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, data, name):
    same(catalog.QUERIES[name](spark, data), views(data), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns
    assert df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "year"
