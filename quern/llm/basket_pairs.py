"""Items that appear together: pair counts over collapsed baskets.

Identical sets of items are collapsed into one basket with a weight, pairs are enumerated once per distinct basket and
the weights are summed. Items too rare to reach the wanted pair support are removed from the baskets first: a pair is
never more frequent than either of its items, so the result stays whole while baskets get shorter and more of them
coincide. A long basket is cut into blocks of items whose pairs of blocks are spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

#: Most frequent items that are carried in the plan as a literal list; more are joined.
LITERAL_ITEMS = 10_000
#: Items of a basket beyond which it is cut into blocks of so many.
BLOCK_ITEMS = 256


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """``(basket, items)``: the set of items of each basket. Rows with a null in either column are left out, repeated
    rows count once. The sets are built on the map side first, so a basket that owns a large share of the rows travels
    as a few sets of distinct items."""
    pairs = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna()
    return pairs.groupBy("basket").agg(F.collect_set("item").alias("items"))


def basket_pairs(
    rows: DataFrame,
    basket: str,
    item: str,
    min_count: int = 1,
    min_share: float = 0.0,
) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, conviction)`` of every pair ``item_a < item_b`` that occurs
    in at least ``min_count`` baskets and in a share of at least ``min_share`` of them.

    ``n_baskets`` counts the baskets with at least one item. ``lift = n_ab * n / (n_a * n_b)``; ``conviction`` of
    a -> b is ``(1 - n_b/n) / (1 - n_ab/n_a)``, null where a never occurs without b. Empty input gives no row. Other
    columns of ``rows``, whatever their names, play no part.
    """
    sets = cut_lineage(baskets(rows, basket, item))
    n, m = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    floor = max(min_count, -int(-min_share * n // 1))
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    frequent = cut_lineage(counts.where(F.col("n") >= floor))
    # At most m / floor items reach the floor.
    if m <= floor * LITERAL_ITEMS or frequent.count() <= LITERAL_ITEMS:
        known = frequent.collect()
        frequent = F.broadcast(sets.sparkSession.createDataFrame(known, counts.schema))
        keep = [r["item"] for r in known]
        kept = F.filter("items", lambda x: x.isin(keep)) if keep else F.array().cast(sets.schema["items"].dataType)
        sets = sets.select(kept.alias("items"))
    elif floor > 1:
        each = sets.select("basket", F.explode("items").alias("item")).join(frequent.select("item"), "item", "left_semi")
        sets = each.groupBy("basket").agg(F.collect_list("item").alias("items"))
    collapsed = (
        sets.where(F.size("items") >= 2)
        .groupBy(F.array_sort("items").alias("items"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    each = _short_pairs(collapsed.where(F.size("items") <= BLOCK_ITEMS)).unionByName(
        _block_pairs(collapsed.where(F.size("items") > BLOCK_ITEMS))
    )
    pairs = each.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= floor)
    return (
        pairs.join(frequent.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(frequent.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("n_baskets", F.lit(n).cast("bigint"))
        .withColumn("lift", F.col("n_ab").cast("double") * n / (F.col("n_a").cast("double") * F.col("n_b")))
        .withColumn("conviction", _conviction(n))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", "lift", "conviction")
    )


def _short_pairs(collapsed: DataFrame) -> DataFrame:
    first = collapsed.select("items", "weight", F.posexplode("items").alias("at", "item_a"))
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    return first.select("item_a", F.explode(rest).alias("item_b"), "weight")


def _block_pairs(collapsed: DataFrame) -> DataFrame:
    """Pairs of the baskets of many items: every two blocks of a basket are a row, and the rows are spread by hash."""

    def block(i: str) -> Column:
        return F.slice("items", F.col(i) * BLOCK_ITEMS + 1, F.lit(BLOCK_ITEMS))

    last = F.ceil(F.size("items") / BLOCK_ITEMS).cast("int") - 1
    left = collapsed.select("items", "weight", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    both = left.select("items", "weight", "i", F.explode(F.sequence("i", "last")).alias("j"))
    rows = both.select("weight", "i", "j", block("i").alias("a"), block("j").alias("b")).repartition("i", "j", "a")
    each = rows.select("weight", "b", F.explode("a").alias("item_a"))
    return each.select("item_a", F.explode("b").alias("item_b"), "weight").where("item_a < item_b")


def _conviction(n: int) -> Column:
    miss = 1 - F.col("n_ab").cast("double") / F.col("n_a")
    return F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b").cast("double") / max(n, 1)) / miss)
