"""Queries of collaborative filtering: users rate the items that their events name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.minhash import PRIME, coefficients
from quern.operators.recsys import centered, item_candidates, item_similarity, mean_ratings, pivoted, predict
from quern.sources.tables import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
MIN_SIMILARITY = 0.1
LSH_BANDS, LSH_ROWS = 30, 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("user_id", item.alias("item"), "event_type", "value")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_ratings(_events(spark, sf_dir), "user_id", "item", "value")


def ratings_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pivoted(_events(spark, sf_dir).where("item is not null"), "item", "event_type", EVENT_TYPES, "value")
    return wide.select("item", *[F.round(c, 6).alias(c) for c in EVENT_TYPES])


def ratings_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centered(_ratings(spark, sf_dir)).select("user", "item", F.round("rating", 6).alias("rating"), F.round("centered", 6).alias("centered"))


def item_lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_candidates(_ratings(spark, sf_dir), LSH_BANDS, LSH_ROWS)


def item_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = item_similarity(centered(_ratings(spark, sf_dir)))
    return found.withColumn("similarity", F.round("similarity", 6))


def item_cosine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the candidate pairs only."""
    ratings = _ratings(spark, sf_dir)
    found = item_similarity(centered(ratings), item_candidates(ratings, LSH_BANDS, LSH_ROWS))
    return found.withColumn("similarity", F.round("similarity", 6))


def predict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _ratings(spark, sf_dir)
    found = predict(ratings, item_similarity(centered(ratings)), MIN_SIMILARITY)
    return found.withColumn("prediction", F.round("prediction", 4))


QUERIES = {f.__name__: f for f in (ratings_pivot, ratings_centered, item_lsh_candidates, item_cosine, item_cosine_candidates, predict_missing)}

_BASE = """
    with v as (select user_id as u, try_cast(json_extract_string(props, '$.k') as int) as i, event_type, value from events),
    r as (select u, i, avg(value) as r from v where u is not null and i is not null and value is not null group by u, i),
    c as (select u, i, r, r - avg(r) over (partition by i) as c from r),
    n as (select i, sqrt(sum(c * c)) as n from c group by i),
    s as (select a.i as i, b.i as j, sum(a.c * b.c) / (any_value(x.n) * any_value(y.n)) as s
          from c a join c b on a.u = b.u and a.i < b.i join n x on x.i = a.i join n y on y.i = b.i where x.n * y.n > 0 group by a.i, b.i),
    w as (select i, j, s from s union all select j, i, s from s)"""

_BANDED = f"""{_BASE},
        f(k, a, b) as (values {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(coefficients(LSH_BANDS * LSH_ROWS)))}),
        g as (select i, k, min((a * u + b) % {PRIME}) as v from r, f group by i, k),
        h as (select i, k // {LSH_ROWS} as band, string_agg(v::varchar, '|' order by k) as key from g group by i, k // {LSH_ROWS}),
        cand as (select distinct x.i as id1, y.i as id2 from h x join h y on x.band = y.band and x.key = y.key and x.i < y.i)"""

ORACLE = {
    "ratings_pivot": _BASE + "select i as item, " + ", ".join(
        f"round(coalesce(max(value) filter (event_type = '{t}'), 0), 6) as {t}" for t in EVENT_TYPES
    ) + " from v where i is not null group by i",
    "ratings_centered": f"{_BASE} select u as user, i as item, round(r, 6) as rating, round(c, 6) as centered from c",
    "item_lsh_candidates": f"{_BANDED} select id1, id2 from cand",
    "item_cosine_candidates": f"""{_BANDED}
        select i as item1, j as item2, round(s, 6) as similarity from s join cand on i = id1 and j = id2""",
    "item_cosine": f"{_BASE} select i as item1, j as item2, round(s, 6) as similarity from s",
    "predict_missing": f"""{_BASE}
        select r.u as user, w.i as item, round(sum(s * r) / sum(abs(s)), 4) as prediction
        from r join w on r.i = w.j where s > {MIN_SIMILARITY} and not exists (select 1 from r q where q.u = r.u and q.i = w.i)
        group by r.u, w.i""",
}
