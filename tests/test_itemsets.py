import pytest

from quern.operators.itemsets import basket_items, frequent_items, frequent_pairs, frequent_triplets, rules_xy, rules_xyz, top_itemsets

BASKETS = {1: [1, 2, 3], 2: [1, 2], 3: [2, 3], 4: [1, 3], 5: [2]}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(b, i) for b, items in BASKETS.items() for i in items] + [(1, 1), (None, 3), (2, None)]
    return basket_items(spark.createDataFrame(rows, "b int, i bigint"), "b", "i").persist()


def test_levels(pairs):
    assert {tuple(r) for r in frequent_items(pairs, 2).collect()} == {(2, 4), (1, 3), (3, 3)}
    assert {tuple(r) for r in frequent_pairs(pairs, 2).collect()} == {(2, 1, 2), (3, 1, 2), (3, 2, 2)}
    assert frequent_triplets(pairs, 2).collect() == []
    assert {tuple(r) for r in frequent_triplets(pairs, 1).collect()} == {(3, 2, 1, 1)}


def test_rules_of_the_worked_example(pairs):
    rules = rules_xy(frequent_items(pairs, 2), frequent_pairs(pairs, 2)).collect()
    got = {(r["x"], r["y"]): tuple(round(r[c], 6) for c in ("confidence", "interest", "lift", "std_lift")) for r in rules}
    assert got == {
        (2, 1): (0.5, 0.2, 1.666667, 0.25),
        (1, 2): (0.666667, 0.266667, 1.666667, 0.25),
        (3, 1): (0.666667, 0.366667, 2.222222, 0.25),
        (1, 3): (0.666667, 0.366667, 2.222222, 0.25),
        (2, 3): (0.5, 0.2, 1.666667, 0.25),
        (3, 2): (0.666667, 0.266667, 1.666667, 0.25),
    }


def test_anti_monotone(pairs):
    l1 = {r["item1"]: r["support"] for r in frequent_items(pairs, 1).collect()}
    for r in frequent_pairs(pairs, 1).collect():
        assert r["support"] <= min(l1[r["item1"]], l1[r["item2"]])


def test_basket_denominator_gives_plain_lift(pairs):
    rules = rules_xy(frequent_items(pairs, 1), frequent_pairs(pairs, 1), "baskets", pairs).collect()
    lift = {(r["x"], r["y"]): r["lift"] for r in rules}
    assert lift[(2, 1)] == pytest.approx(2 * 5 / (4 * 3))


def test_three_rules_per_triplet(pairs):
    l1, l2, l3 = frequent_items(pairs, 1), frequent_pairs(pairs, 1), frequent_triplets(pairs, 1)
    assert {(r["x"], r["y"], r["z"]) for r in rules_xyz(l1, l2, l3).collect()} == {(3, 2, 1), (3, 1, 2), (2, 1, 3)}


def test_ties_go_by_item(pairs):
    assert [r["item1"] for r in top_itemsets(frequent_items(pairs, 1), 3).collect()] == [2, 1, 3]


def test_empty(spark):
    none = basket_items(spark.createDataFrame([], "b int, i bigint"), "b", "i")
    assert rules_xy(frequent_items(none, 1), frequent_pairs(none, 1)).collect() == []
