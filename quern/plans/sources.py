"""Queries of the readers: each writes a test table in the format, reads it back and counts what came through.

The files lie in the checkpoint folder of the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import shared_folder
from quern.sources.readers import (
    numeric_array,
    read_conditions,
    read_csv_header,
    read_edge_folder,
    read_edges,
    read_json_lines,
    read_lines,
    read_multi_header_csv,
    read_ratings,
    read_suggestion_object,
    read_suggestions,
)
from quern.sources.sinks import write_parquet, write_suggestions
from quern.sources.tables import table

#: Text is written as it is, without trimming.
PLAIN = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
WIDTH = 64


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def source_conditions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header, gzip: rows and patients per readable code."""
    place = shared_folder(spark)
    rows = table(spark, sf_dir, "conditions").select(
        F.col("onset_date").alias("START"), F.col("resolved_date").alias("STOP"), F.col("patient").alias("PATIENT"),
        F.lit("e").alias("ENCOUNTER"), F.col("code").alias("CODE"), F.col("description").alias("DESCRIPTION"),
    )
    rows.write.options(header=True, compression="gzip", **PLAIN).csv(place)
    return read_conditions(spark, place, partitions=8).groupBy("code").agg(
        _n(), F.count("patient").alias("n_patient"), F.count("description").alias("n_description")
    )


def source_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a CSV with a header, bzip2."""
    place = shared_folder(spark)
    table(spark, sf_dir, "orders").write.options(header=True, compression="bzip2").csv(place)
    rows = read_csv_header(spark, place, "o_orderpriority", "o_orderstatus")
    return rows.groupBy("o_orderpriority", "o_orderstatus").agg(_n())


def source_news_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, gzip: length of each article."""
    place = shared_folder(spark)
    table(spark, sf_dir, "covid_news_full").select("tweet_id", "text", "url").write.option("compression", "gzip").json(place)
    return read_json_lines(spark, place).groupBy("tweet_id", F.length("text").alias("n_chars")).agg(_n(), F.count("url").alias("n_url"))


def source_multi_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose first two lines name the columns together and whose third is left out: sum of each row's numbers."""
    place = shared_folder(spark)
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("n"), F.concat_ws(",", "vec_id", *[F.col("embedding")[i] for i in range(WIDTH)]).alias("line")
    )
    head = ["id" + ",e" * WIDTH, "," + ",".join(str(i) for i in range(WIDTH)), "id" + "," * WIDTH]
    top = spark.createDataFrame([(i - 10, line) for i, line in enumerate(head)], "n bigint, line string")
    top.unionByName(rows).coalesce(1).sortWithinPartitions("n").select("line").write.text(place)
    vectors = numeric_array(read_multi_header_csv(spark, place, header_rows=2, skip_rows=1), "id")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return vectors.select(F.col("id").cast("bigint").alias("vec_id"), F.size("vector").alias("width"), F.round(total, 4).alias("total"))


def source_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated ratings without a header: number and mean per user."""
    place = shared_folder(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lit("0").alias("t"))
    rows.write.option("sep", "\t").csv(place)
    return read_ratings(spark, place).groupBy("user").agg(_n(), F.round(F.avg("rating"), 4).alias("mean"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ca_hepph").where("src is not null and dst is not null")


def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge list in lines, with comments and empty lines, gzip."""
    place = shared_folder(spark)
    lines = _edges(spark, sf_dir).select(F.concat_ws("\t", "src", "dst").alias("value"))
    more = spark.createDataFrame([("# Nodes: 3 Edges: 4",), ("",), ("# FromNodeId ToNodeId",)], "value string")
    lines.unionByName(more).write.option("compression", "gzip").text(place)
    return read_edges(spark, place).groupBy("src", "dst").agg(_n())


def source_edge_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files of edges: edges and nodes of every file together, by the file's graph."""
    place = shared_folder(spark)
    rows = _edges(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("value"))
    rows.coalesce(1).write.text(place)
    found = read_edge_folder(spark, place, ".txt")
    one_file = F.count_distinct("graph").alias("n_graphs")
    return found.groupBy(F.pmod("src", F.lit(4)).alias("part")).agg(_n(), one_file, F.count_distinct("dst").alias("n_dst"))


def source_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of each node as JSON lines, written and read, and once more as one JSON object."""
    place, whole = shared_folder(spark), shared_folder(spark)
    ends = [F.col(c).cast("string").alias(n) for c, n in (("n_regionkey", "id_a"), ("n_name", "id_b"))]
    write_suggestions(table(spark, sf_dir, "nation").select(*ends), place)
    lines = read_suggestions(spark, place)
    pairs = F.map_from_entries(F.collect_list(F.struct("id", "similar")))
    lines.agg(F.to_json(pairs).alias("value")).write.text(whole)
    both = lines.unionByName(read_suggestion_object(spark, whole))
    return both.select("id", F.explode("similar").alias("other")).groupBy("id", "other").agg(_n())


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines, gzip: how many there are of each length."""
    place = shared_folder(spark)
    table(spark, sf_dir, "part").select("p_name").write.option("compression", "gzip").text(place)
    return read_lines(spark, place).groupBy(F.length("value").alias("n_chars")).agg(_n())


def sink_parquet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet partitioned by a column, read back."""
    place = shared_folder(spark)
    write_parquet(table(spark, sf_dir, "orders"), place, ["o_orderstatus"])
    back = spark.read.parquet(place)
    return back.groupBy("o_orderstatus").agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        source_conditions_csv, source_csv_columns, source_news_jsonl, source_multi_header, source_ratings, source_edges,
        source_edge_folder, source_suggestions, source_lines, sink_parquet_parts,
    )
}

ORACLE = {
    "source_conditions_csv": r"""
        select case when regexp_full_match(trim(code, e' \t\n\r'), '[+-]?[0-9]+') then try_cast(trim(code, e' \t\n\r') as bigint) end as code,
               count(*) as n, count(nullif(patient, '')) as n_patient, count(description) as n_description
        from conditions group by 1""",
    "source_csv_columns": "select o_orderpriority, o_orderstatus, count(*) as n from orders group by all",
    "source_news_jsonl": """
        select tweet_id, length(text)::int as n_chars, count(*) as n, count(url) as n_url from covid_news_full group by 1, 2""",
    "source_multi_header": f"""
        select vec_id, {WIDTH} as width, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings""",
    "source_ratings": "select user_id as user, count(*) as n, round(avg(value), 4) as mean from events group by 1",
    "source_edges": "select src, dst, count(*) as n from ca_hepph where src is not null and dst is not null group by 1, 2",
    "source_edge_folder": """
        select src % 4 as part, count(*) as n, 1::bigint as n_graphs, count(distinct dst) as n_dst
        from ca_hepph where src is not null and dst is not null group by 1""",
    "source_suggestions": """
        with p as (select n_regionkey::varchar as a, n_name as b from nation),
        e as (select distinct a as id, b as other from p union select distinct b, a from p)
        select id, other, 2::bigint as n from e""",
    "source_lines": "select length(p_name)::int as n_chars, count(*) as n from part group by 1",
    "sink_parquet_parts": "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1",
}
