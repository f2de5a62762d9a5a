"""Queries for items that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.basket_pairs import basket_pairs
from quern.sources.tables import condition_items


def _whole(c: str):
    return F.col(c).cast("decimal(19,0)")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = basket_pairs(condition_items(spark, sf_dir), "patient", "code", min_count=6, min_share=0.01)
    often = _whole("n_ab") * _whole("n_baskets") >= _whole("n_a") * _whole("n_b") * 4
    return pairs.where(often).select(F.col("item_a").alias("code_a"), F.col("item_b").alias("code_b"))


def p1_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = basket_pairs(condition_items(spark, sf_dir), "patient", "code", min_count=6)
    scores = [F.round(c, 6).alias(c) for c in ("lift", "conviction")]
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", *scores)


QUERIES = {"p1_found": p1_found, "p1_pair_scores": p1_pair_scores}

_PAIRS = r"""
    with c as (
        select distinct regexp_replace(lower(patient), '^\s+|\s+$', '', 'g') as p,
               try_cast(nullif(regexp_extract(code, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint) as c
        from conditions),
    b as (select p, c from c where p is not null and c is not null),
    i as (select c, count(*) as n from b group by c),
    t as (select count(distinct p) as n from b),
    x as (select l.c as a, r.c as b, count(*) as n from b l join b r on l.p = r.p and l.c < r.c group by all)"""

ORACLE = {
    "p1_found": f"""{_PAIRS}
        select a as code_a, b as code_b from x join i ia on ia.c = a join i ib on ib.c = b, t
        where x.n >= 6 and x.n * 100 >= t.n and x.n * t.n >= 4 * ia.n * ib.n""",
    "p1_pair_scores": f"""{_PAIRS}
        select a as item_a, b as item_b, x.n as n_ab, ia.n as n_a, ib.n as n_b, t.n as n_baskets,
               round(x.n::double * t.n / (ia.n::double * ib.n), 6) as lift,
               round(case when x.n < ia.n then (1 - ib.n::double / t.n) / (1 - x.n::double / ia.n) end, 6) as conviction
        from x join i ia on ia.c = a join i ib on ib.c = b, t where x.n >= 6""",
}
