"""Item-item collaborative filtering on ratings in long form ``(user, item, rating)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.similarity import bands, candidate_pairs, signatures


def mean_ratings(rows: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """One row per user and item, the mean of its ratings; rows with a null are left out."""
    rows = rows.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).alias("rating")).dropna()
    return rows.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def pivoted(rows: DataFrame, item: str, column: str, values: list, rating: str) -> DataFrame:
    """One row per item and one column per given value, the greatest rating, 0 where there is none. A view for small
    numbers of columns; all other operators work on the long form."""
    return rows.groupBy(item).pivot(column, values).agg(F.max(rating)).na.fill(0)


def centered(ratings: DataFrame) -> DataFrame:
    """``ratings`` plus ``centered`` = rating - mean of the item. A rating equal to the mean stays an observed 0. The
    means are one row per item, counted on the map side."""
    means = ratings.groupBy("item").agg(F.avg("rating").alias("mean"))
    return ratings.join(means, "item").select("user", "item", "rating", (F.col("rating") - F.col("mean")).alias("centered"))


def item_candidates(ratings: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """Pairs of items whose sets of users share a band of min-hash signatures. ``user`` must be a non-negative integer
    below 2^28."""
    sets = ratings.groupBy(F.col("item").alias("id")).agg(F.collect_set(F.col("user").cast("bigint")).alias("hashes"))
    return candidate_pairs(bands(signatures(sets, n_bands * rows), n_bands, rows))


def item_similarity(scored: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(item1, item2, similarity)``, ``item1 < item2``: cosine of the centered ratings, over items with a common user
    and, if given, only of the ``candidates`` (``id1``, ``id2``). Zero vectors have no similarity."""
    norms = scored.groupBy("item").agg(F.sqrt(F.sum(F.col("centered") * F.col("centered"))).alias("norm"))
    a = scored.select("user", F.col("item").alias("item1"), F.col("centered").alias("c1"))
    b = scored.select("user", F.col("item").alias("item2"), F.col("centered").alias("c2"))
    if candidates is None:
        both = a.join(b, "user").where("item1 < item2")
    else:
        # Each rating meets the candidates of its item only, never all of the user's other ratings.
        wanted = candidates.select(F.col("id1").alias("item1"), F.col("id2").alias("item2"))
        both = a.join(wanted, "item1").join(b, ["user", "item2"])
    dots = both.groupBy("item1", "item2").agg(F.sum(F.col("c1") * F.col("c2")).alias("dot"))
    n1 = norms.select(F.col("item").alias("item1"), F.col("norm").alias("n1"))
    n2 = norms.select(F.col("item").alias("item2"), F.col("norm").alias("n2"))
    share = F.try_divide(F.col("dot"), F.col("n1") * F.col("n2"))
    return dots.join(n1, "item1").join(n2, "item2").select("item1", "item2", share.alias("similarity")).dropna()


def predict(ratings: DataFrame, similarity: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """``(user, item, prediction)`` of items the user has not rated: the mean of the user's ratings of similar items
    weighted by similarity, over items of similarity above ``min_similarity``."""
    kept = similarity.where(F.col("similarity") > min_similarity)
    both = kept.select(F.col("item1").alias("item"), F.col("item2").alias("rated"), "similarity").unionByName(
        kept.select(F.col("item2").alias("item"), F.col("item1").alias("rated"), "similarity")
    )
    terms = ratings.withColumnRenamed("item", "rated").join(both, "rated")
    weighted = F.sum(F.col("similarity") * F.col("rating")) / F.sum(F.abs("similarity"))
    found = terms.groupBy("user", "item").agg(weighted.alias("prediction"))
    return found.join(ratings.select("user", "item"), ["user", "item"], "left_anti")
