"""Queries of the skew operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.parse import integer_text
from quern.operators.skew import skew_aggregate, skew_distinct_counts, skew_join
from quern.sources.tables import condition_items, table

FOUND_SHARE = 0.02


def _heavy_of(rows: DataFrame, key: str, name: str) -> DataFrame:
    counts = skew_aggregate(rows, key, {"n": F.count(F.lit(1))}, {"n": F.sum}, FOUND_SHARE)
    # Only keys the sketch names can reach the share; the total needs all keys.
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.where("heavy")
        .join(F.broadcast(total), F.col("n") * 50 >= F.col("total"))
        .select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("key_value"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "conditions").select(integer_text("code").alias("code"))
    edges = table(spark, sf_dir, "ca_hepph").select("src")
    return _heavy_of(codes, "code", "conditions").unionByName(_heavy_of(edges, "src", "ca_hepph"))


def p3_code_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conditions").select(
        integer_text("code").alias("code"), "onset_date", "resolved_date"
    )
    stats = skew_aggregate(
        rows,
        "code",
        {
            "n_rows": F.count(F.lit(1)),
            "n_open": F.count_if(F.col("resolved_date").isNull()),
            "first_onset": F.min("onset_date"),
            "last_onset": F.max("onset_date"),
            "resolved_days": F.sum(F.date_diff("resolved_date", "onset_date")).cast("bigint"),
        },
        {"n_rows": F.sum, "n_open": F.sum, "first_onset": F.min, "last_onset": F.max, "resolved_days": F.sum},
    ).drop("heavy")
    patients = skew_distinct_counts(condition_items(spark, sf_dir), "code", "patient")
    return stats.join(patients.withColumnRenamed("n_distinct", "n_patients"), "code")


def p3_src_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "ca_hepph").select("src", "dst")
    stats = skew_aggregate(
        edges,
        "src",
        {"n_rows": F.count(F.lit(1)), "n_loops": F.count_if(F.col("src") == F.col("dst"))},
        {"n_rows": F.sum, "n_loops": F.sum},
    ).drop("heavy")
    return stats.join(skew_distinct_counts(edges, "src", "dst").withColumnRenamed("n_distinct", "n_dst"), "src")


def p3_edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge joined with the number of rows that name its source as a target: a join skewed on ``src``."""
    edges = table(spark, sf_dir, "ca_hepph").select("src", "dst")
    indegree = edges.where("dst is not null").groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("n_in"))
    joined = skew_join(edges, indegree, "src", "left")
    return joined.groupBy(F.coalesce("n_in", F.lit(0)).alias("n_in")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src")
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_code_profile": p3_code_profile,
    "p3_src_profile": p3_src_profile,
    "p3_edge_degrees": p3_edge_degrees,
}

_CODE = r"try_cast(nullif(regexp_extract(code, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint)"

ORACLE = {
    "p3_found": f"""
        with k as (
            select 'conditions' as table_name, {_CODE} as key_value from conditions
            union all select 'ca_hepph', src from ca_hepph),
        n as (select table_name, key_value, count(*) as n from k where key_value is not null group by all)
        select table_name, key_value from n
        qualify n * 50 >= sum(n) over (partition by table_name)""",
    "p3_code_profile": rf"""
        with c as (select {_CODE} as code, regexp_replace(lower(patient), '^\s+|\s+$', '', 'g') as patient,
                          onset_date, resolved_date from conditions)
        select code, count(*) as n_rows, count(*) filter (resolved_date is null) as n_open,
               min(onset_date) as first_onset, max(onset_date) as last_onset,
               cast(sum(date_diff('day', onset_date, resolved_date)) as bigint) as resolved_days,
               count(distinct patient) as n_patients
        from c where code is not null group by code""",
    "p3_src_profile": """
        select src, count(*) as n_rows, count(*) filter (src = dst) as n_loops, count(distinct dst) as n_dst
        from ca_hepph where src is not null group by src""",
    "p3_edge_degrees": """
        with d as (select dst as k, count(*) as n_in from ca_hepph where dst is not null group by dst)
        select coalesce(n_in, 0) as n_in, count(*) as n_edges, count(distinct src) as n_src
        from ca_hepph left join d on src = k group by 1""",
}
