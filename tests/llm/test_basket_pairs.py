from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.llm.basket_pairs import basket_pairs


def brute(rows, min_count=1, min_share=0.0):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = len(baskets)
    one = Counter(i for s in baskets.values() for i in s)
    two = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {p: (c, one[p[0]], one[p[1]], n) for p, c in two.items() if c >= min_count and c >= min_share * n}


def run(spark, rows, **how):
    df = spark.createDataFrame([(b, i, b, 1) for b, i in rows], "who string, what bigint, items string, n int")
    got = basket_pairs(df, "who", "what", **how).collect()
    return {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in got}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", "", None]), st.one_of(st.none(), st.integers(0, 6))), max_size=60), st.integers(1, 3))
def test_equals_brute_force(spark, rows, least):
    assert run(spark, rows, min_count=least) == brute(rows, least)


def test_scores(spark):
    rows = [("p", 1), ("p", 2), ("q", 1), ("q", 2), ("r", 1), ("s", 3)]
    r = basket_pairs(spark.createDataFrame(rows, "b string, i bigint"), "b", "i").first()
    assert r["lift"] == pytest.approx(2 * 4 / (3 * 2)) and r["conviction"] == pytest.approx((1 - 2 / 4) / (1 - 2 / 3))
    always = basket_pairs(spark.createDataFrame(rows[:4], "b string, i bigint"), "b", "i").first()
    assert always["conviction"] is None


def test_share_and_hot_basket(spark):
    rows = [("hot", i % 40) for i in range(4000)] + [(f"b{j}", i) for j in range(30) for i in (1, 2)] + [("hot", 1)] * 500
    assert run(spark, rows, min_share=0.5) == brute(rows, min_share=0.5)


@pytest.mark.parametrize("literal", [0, 10_000])
def test_long_baskets_and_many_items(spark, monkeypatch, literal):
    """Blocks of items give the pairs of a basket that owns most rows; rare items leave by the join as by the list."""
    import quern.llm.basket_pairs as module

    monkeypatch.setattr(module, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(module, "LITERAL_ITEMS", literal)
    rows = [("hot", i) for i in range(60)] + [(f"b{j}", i) for j in range(25) for i in range(j % 9)] + [("c", 500), (None, 1)]
    for least in (1, 3):
        assert run(spark, rows, min_count=least) == brute(rows, least)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(None, 1), ("a", None)]) == {}
