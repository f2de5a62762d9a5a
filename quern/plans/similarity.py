"""Queries of the near-duplicate text search over the news articles."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.minhash import PRIME, PUNCTUATION, clean_tokens, coefficients, text_shingles
from quern.operators.similarity import (
    bands,
    candidate_pairs,
    collapse,
    exact_pairs,
    jaccard,
    quality,
    shingle_sets,
    signatures,
    similar_to,
    tune,
)
from quern.sources.tables import table

K, BANDS, ROWS, SIMILAR = 10, 13, 11, 0.85
#: Frequent function words of Portuguese, a parameter of the cleaning.
STOP_WORDS = (
    "a", "ao", "aos", "as", "com", "como", "da", "das", "de", "do", "dos", "e", "em", "entre", "foi", "mais", "mas",
    "na", "nas", "no", "nos", "não", "o", "os", "ou", "para", "pela", "pelo", "por", "que", "se", "sem", "ser", "seu",
    "sua", "um", "uma",
)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash sets of the articles, kept for the several uses within a query."""
    news = table(spark, sf_dir, "covid_news_full").select("tweet_id", "text")
    return shingle_sets(news, "tweet_id", "text", K, STOP_WORDS).persist(StorageLevel.MEMORY_AND_DISK)


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Representatives, kept for the several uses within a query, and members."""
    reps, members = collapse(_sets(spark, sf_dir))
    return reps.persist(StorageLevel.MEMORY_AND_DISK), members


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)[0]


def _candidates(reps: DataFrame) -> DataFrame:
    return candidate_pairs(bands(signatures(reps, BANDS * ROWS), BANDS, ROWS))


def doc_clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(clean_tokens("text", STOP_WORDS), " ").alias("tokens"))


def doc_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir)
    return sets.select("id", F.size("hashes").alias("n"), F.aggregate("hashes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


def shingle_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the shingles by the whole MD5 digest: the 28 bits of the hash sets would merge different ones."""
    news = table(spark, sf_dir, "covid_news_full").where("tweet_id is not null and text is not null")
    once = news.groupBy("tweet_id").agg(F.min("text").alias("text"))
    shingles = once.select(F.explode(text_shingles(clean_tokens("text", STOP_WORDS), K)).alias("s"))
    return shingles.select(F.unhex(F.md5("s")).alias("h")).agg(F.count_distinct("h").alias("n_shingles"))


def lsh_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tune(spark, [(13, 11), (20, 5), (25, 6), (50, 3)])
    return rows.select("bands", "rows", *[F.round(c, 6).alias(c) for c in ("threshold", "miss", "false_candidate")])


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = signatures(_reps(spark, sf_dir), BANDS * ROWS)
    return signed.select("id", F.array_join(F.col("signature").cast("array<string>"), "|").alias("signature"))


def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = bands(signatures(_reps(spark, sf_dir), BANDS * ROWS), BANDS, ROWS)
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    return shared


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(_reps(spark, sf_dir))


def jaccard_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_pairs(_reps(spark, sf_dir), 0.6).withColumn("similarity", F.round("similarity", 6))


def similar_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = _reps(spark, sf_dir)
    found = similar_to(jaccard(_candidates(reps), reps), SIMILAR)
    return found.withColumn("similarity", F.round("similarity", 6))


def similar_doc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article with its class of equal texts and the number of classes that are similar to it."""
    reps, members = _classes(spark, sf_dir)
    links = similar_to(jaccard(_candidates(reps), reps), SIMILAR).groupBy(F.col("id").alias("rep")).agg(
        F.count(F.lit(1)).alias("n_similar")
    )
    return members.join(links, "rep", "left").select("id", "rep", F.coalesce("n_similar", F.lit(0)).alias("n_similar"))


def lsh_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = _reps(spark, sf_dir)
    return quality(_candidates(reps), exact_pairs(reps, SIMILAR), reps, SIMILAR)


QUERIES = {
    f.__name__: f
    for f in (
        doc_clean_tokens, doc_shingles, shingle_distinct_count, lsh_tune, minhash_signatures, lsh_bands, lsh_candidates,
        jaccard_pairs_exact, similar_docs, similar_doc_classes, lsh_quality,
    )
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = rf"""list_filter(regexp_split_to_array(regexp_replace(text, '{PUNCTUATION}', '', 'g'), '[ \t\n\x0B\f\r]+'),
                           lambda w: w <> '' and lower(w) not in ({_STOP}))"""
_SETS = f"""
    with x as (select tweet_id as id, min(text) as text from covid_news_full
               where tweet_id is not null and text is not null group by tweet_id),
    w as (select id, {_TOKENS} as w from x),
    h as (select distinct id, ('0x' || substr(md5(s), 1, 7))::bigint as h
          from (select id, unnest([array_to_string(w[i:i+{K - 1}], ' ') for i in range(1, len(w) - {K - 2})]) as s
                from w where len(w) >= {K})),
    k as (select id, md5(string_agg(h::varchar, ',' order by h)) as k, count(*) as n from h group by id),
    m as (select id, min(id) over (partition by k) as rep, n from k),
    r as (select h.* from h semi join (select id from m where id = rep) q on q.id = h.id)"""
_FAMILY = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients(BANDS * ROWS)))
_SIGNED = f"""{_SETS},
    p(i, a, b) as (values {_FAMILY}),
    g as (select id, i, min((a * h + b) % {PRIME}) as v from r, p group by id, i),
    b as (select id, (i // {ROWS})::varchar || '|' || string_agg(v::varchar, '|' order by i) as band
          from g group by id, i // {ROWS}),
    c as (select distinct x.id as id1, y.id as id2 from b x join b y on x.band = y.band and x.id < y.id),
    e as (select x.id as id1, y.id as id2, count(*)::double / (any_value(mx.n) + any_value(my.n) - count(*)) as s
          from r x join r y on x.h = y.h and x.id < y.id join m mx on mx.id = x.id join m my on my.id = y.id group by x.id, y.id),
    v as (select c.id1, c.id2, coalesce(s, 0) as s from c left join e using (id1, id2)),
    d as (select id1 as id, id2 as other, s from v where s >= {SIMILAR} union all select id2, id1, s from v where s >= {SIMILAR})"""

ORACLE = {
    "doc_clean_tokens": f"select doc_id, array_to_string({_TOKENS}, ' ') as tokens from documents where text is not null",
    "doc_shingles": f"{_SETS} select id, count(*) as n, sum(h)::bigint as total from h group by id",
    # The shingles themselves: the 28 bits of the hash sets would merge different ones.
    "shingle_distinct_count": f"""{_SETS}
        select count(distinct s) as n_shingles
        from (select unnest([array_to_string(w[i:i+{K - 1}], ' ') for i in range(1, len(w) - {K - 2})]) as s from w where len(w) >= {K})""",
    "lsh_tune": """
        select b as bands, r as rows, round(pow(1.0::double / b, 1.0::double / r), 6) as threshold,
               round(pow(1 - pow(0.85::double, r), b), 6) as miss, round(1 - pow(1 - pow(0.6::double, r), b), 6) as false_candidate
        from (values (13, 11), (20, 5), (25, 6), (50, 3)) t(b, r)""",
    "minhash_signatures": f"{_SIGNED} select id, string_agg(v::varchar, '|' order by i) as signature from g group by id",
    "lsh_bands": f"{_SIGNED} select band, count(*) as n_docs from b group by band having count(*) > 1",
    "lsh_candidates": f"{_SIGNED} select id1, id2 from c",
    "jaccard_pairs_exact": f"{_SIGNED} select id1, id2, round(s, 6) as similarity from e where s >= 0.6",
    "similar_docs": f"{_SIGNED} select id, other, round(s, 6) as similarity from d",
    "similar_doc_classes": f"""{_SIGNED} select id, rep, coalesce(n_links, 0) as n_similar
        from m left join (select id as q, count(*) as n_links from d group by id) on q = rep""",
    "lsh_quality": f"""{_SIGNED}
        select *, n_similar - n_found as n_missed from (
            select (select count(*) from v) as n_candidates, (select count(*) from v where s >= {SIMILAR}) as n_found,
                   (select count(*) from v where s < {SIMILAR}) as n_false_candidates,
                   (select count(*) from e where s >= {SIMILAR}) as n_similar)""",
}
