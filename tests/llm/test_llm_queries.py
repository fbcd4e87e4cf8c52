import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, same
from vertexloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
