"""Queries for near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.edit_groups import NearDuplicates
from quern.sources.tables import table


def _articles(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    news = table(spark, sf_dir, "covid_news_full").select("tweet_id", "text")
    return NearDuplicates(news, "tweet_id", "text", shingle=3, threshold=0.6, min_words=10)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _articles(spark, sf_dir).pairs()
    return pairs.select(F.col("id_a").alias("tweet_a"), F.col("id_b").alias("tweet_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).groups().withColumnRenamed("id", "tweet_id")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}

_PAIRS = r"""
    with recursive x as (select tweet_id, regexp_extract_all(lower(min(text)), '[\p{L}\p{N}]+') as w
                         from covid_news_full where text is not null group by tweet_id),
    w as (select * from x where len(w) >= 10),
    s as (select distinct tweet_id, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) as s from w),
    n as (select tweet_id, count(*) as n from s group by all),
    c as (select a.tweet_id as a, b.tweet_id as b, count(*) as c
          from s a join s b on a.s = b.s and a.tweet_id < b.tweet_id group by all),
    p as (select a, b from c join n x on x.tweet_id = a join n y on y.tweet_id = b where c::double / (x.n + y.n - c) >= 0.6)"""

ORACLE = {
    "p5_found": f"{_PAIRS} select a as tweet_a, b as tweet_b from p",
    "p5_groups": f"""{_PAIRS},
        e as (select a, b from p union all select b, a from p),
        r as (select a as node, a as root from e group by a union select e.b, r.root from r join e on r.node = e.a where r.root < e.b),
        g as (select node, min(root) as group_id from r group by node),
        k as (select tweet_id, array_to_string(w, ' ') as k from w),
        l as (select e.a, count(distinct y.k) as class_links from e join k x on x.tweet_id = e.a join k y on y.tweet_id = e.b
              where x.k <> y.k group by e.a)
        select tweet_id, coalesce(group_id, tweet_id) as group_id, coalesce(class_links, 0) as class_links
        from w left join g on node = tweet_id left join l on l.a = tweet_id""",
}
