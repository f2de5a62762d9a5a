import pytest

from quern.plans.registry import core_oracle, core_queries

ORACLE, QUERIES = core_oracle(), core_queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(name, spark, small):
    assert QUERIES[name](spark, small.replace("sf0.001", "sf0.01")).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
