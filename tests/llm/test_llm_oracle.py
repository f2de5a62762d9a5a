import pytest

from quern.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() >= 0
