"""Frequent itemsets of one to three items and association rules.

Everything is one lazy plan over ``(basket, item)`` rows: a basket keeps only items that are frequent on their own
(Apriori), pairs and triplets are enumerated inside the basket's sorted array, and counted with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("confidence", "interest", "lift", "std_lift")


def basket_items(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``(basket, item)`` of the rows without a null in either."""
    return rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()


def frequent_items(pairs: DataFrame, min_support: int) -> DataFrame:
    """``(item1, support)`` of the items in at least ``min_support`` baskets. ``pairs``: distinct (basket, item)."""
    counts = pairs.groupBy(F.col("item").alias("item1")).agg(F.count(F.lit(1)).alias("support"))
    return counts.where(F.col("support") >= min_support)


def _pruned_baskets(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` array per basket, larger items first, frequent items only."""
    kept = pairs.join(items.select(F.col("item1").alias("item")), "item", "left_semi")
    sets = kept.groupBy("basket").agg(F.sort_array(F.collect_set("item"), asc=False).alias("items"))
    return sets.where(F.size("items") >= 2)


def frequent_pairs(pairs: DataFrame, min_support: int, items: DataFrame | None = None) -> DataFrame:
    """``(item1, item2, support)`` with ``item1 > item2``; empty if there is none."""
    items = frequent_items(pairs, min_support) if items is None else items
    at = _pruned_baskets(pairs, items).select("items", F.posexplode("items").alias("i", "item1"))
    both = at.select("item1", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item2"))
    counts = both.groupBy("item1", "item2").agg(F.count(F.lit(1)).alias("support"))
    return counts.where(F.col("support") >= min_support)


def frequent_triplets(
    pairs: DataFrame, min_support: int, items: DataFrame | None = None, l2: DataFrame | None = None
) -> DataFrame:
    """``(item1, item2, item3, support)`` with ``item1 > item2 > item3``. Every pair inside must be frequent: the two
    that start at ``item1`` prune before triplets are formed, the third after counting."""
    items = frequent_items(pairs, min_support) if items is None else items
    l2 = frequent_pairs(pairs, min_support, items) if l2 is None else l2
    at = _pruned_baskets(pairs, items).select("basket", "items", F.posexplode("items").alias("i", "item1"))
    both = at.select("basket", "item1", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item2"))
    firm = both.join(l2.select("item1", "item2"), ["item1", "item2"], "left_semi")
    tails = firm.groupBy("basket", "item1").agg(F.sort_array(F.collect_list("item2"), asc=False).alias("tail"))
    mid = tails.where(F.size("tail") >= 2).select("item1", "tail", F.posexplode("tail").alias("j", "item2"))
    triple = mid.select("item1", "item2", F.explode(F.slice("tail", F.col("j") + 2, F.size("tail"))).alias("item3"))
    counts = triple.groupBy("item1", "item2", "item3").agg(F.count(F.lit(1)).alias("support"))
    last = l2.select(F.col("item1").alias("item2"), F.col("item2").alias("item3"))
    return counts.where(F.col("support") >= min_support).join(last, ["item2", "item3"], "left_semi").select(
        "item1", "item2", "item3", "support"
    )


def top_itemsets(itemsets: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent itemsets; ties go by the smaller items."""
    items = [c for c in itemsets.columns if c.startswith("item")]
    return itemsets.orderBy(F.desc("support"), *items).limit(n)


def _total(counts: DataFrame, name: str) -> DataFrame:
    return F.broadcast(counts.agg(F.sum("support").cast("double").alias(name)))


def _std_lift(lift: Column, px: Column, py: Column, n: Column) -> Column:
    """Lift between its least and greatest possible value for the given probabilities."""
    least = F.greatest(px + py - 1, 1 / n) / (px * py)
    return F.try_divide(lift - least, 1 / F.greatest(px, py) - least)


def _metrics(supp_x: str, px: Column, py: Column, n: Column) -> list[Column]:
    confidence = F.col("support") / F.col(supp_x)
    lift = confidence / py
    return [
        confidence.alias("confidence"),
        (confidence - py).alias("interest"),
        lift.alias("lift"),
        _std_lift(lift, px, py, n).alias("std_lift"),
    ]


def rules_xy(l1: DataFrame, l2: DataFrame, denominator: str = "items", baskets: DataFrame | None = None) -> DataFrame:
    """``(x, y, confidence, interest, lift, std_lift)`` of x -> y for both directions of each pair.

    ``denominator="items"``: probabilities are shares of the summed support of all frequent items, and the number in
    ``std_lift`` is the summed support of all frequent pairs; ``std_lift`` can then exceed 1. ``"baskets"``: both are
    the number of baskets, from ``baskets`` (distinct (basket, item)).
    """
    both = l2.select(F.col("item1").alias("x"), F.col("item2").alias("y"), "support").unionByName(
        l2.select(F.col("item2").alias("x"), F.col("item1").alias("y"), "support")
    )
    if denominator == "items":
        totals = _total(l1, "t1").crossJoin(_total(l2, "t2"))
    else:
        n = baskets.agg(F.count_distinct("basket").cast("double").alias("t1"))
        totals = F.broadcast(n.withColumn("t2", F.col("t1")))
    joined = (
        both.join(l1.select(F.col("item1").alias("x"), F.col("support").alias("sx")), "x")
        .join(l1.select(F.col("item1").alias("y"), F.col("support").alias("sy")), "y")
        .crossJoin(totals)
    )
    px, py = F.col("sx") / F.col("t1"), F.col("sy") / F.col("t1")
    return joined.select("x", "y", *_metrics("sx", px, py, F.col("t2")))


def rules_xyz(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """``(x, y, z, confidence, interest, lift, std_lift)`` of {x, y} -> z with ``x > y``, for the three ways to take z
    out of each triplet. The probability of a pair is its share of the summed support of all frequent pairs, that of z
    its share among items; the number in ``std_lift`` is the summed support of all frequent triplets."""
    ways = F.array(
        *[
            F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.col(c).alias("z"))
            for a, b, c in (("item1", "item2", "item3"), ("item1", "item3", "item2"), ("item2", "item3", "item1"))
        ]
    )
    split = l3.select("support", F.inline(ways))
    totals = _total(l1, "t1").crossJoin(_total(l2, "t2")).crossJoin(_total(l3, "t3"))
    joined = (
        split.join(l2.select(F.col("item1").alias("x"), F.col("item2").alias("y"), F.col("support").alias("sxy")), ["x", "y"])
        .join(l1.select(F.col("item1").alias("z"), F.col("support").alias("sz")), "z")
        .crossJoin(totals)
    )
    pxy, pz = F.col("sxy") / F.col("t2"), F.col("sz") / F.col("t1")
    return joined.select("x", "y", "z", *_metrics("sxy", pxy, pz, F.col("t3")))


def select_rules(rules: DataFrame, min_std_lift: float) -> DataFrame:
    """Rules of at least ``min_std_lift``, the strongest first; ties go by the items."""
    keys = [c for c in rules.columns if c not in METRICS]
    return rules.where(F.col("std_lift") >= min_std_lift).orderBy(F.desc("std_lift"), *keys)
