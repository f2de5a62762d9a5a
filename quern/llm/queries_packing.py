"""Queries for filling containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.packing import fill_summary, pack_containers, packing_faults, token_counts
from quern.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = table(spark, sf_dir, "pack_targets").select("target_id", "capacity_tokens").dropna().distinct().collect()
    return sorted((r["target_id"], r["capacity_tokens"]) for r in rows)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_containers(token_counts(docs, TOKENIZER), _capacities(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_summary(p6_containers(spark, sf_dir), _capacities(spark, sf_dir)).withColumn(
        "fill", F.round("fill", 4)
    )


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the number of packed documents, and of faults of which there must be none."""
    packed = p6_containers(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return packing_faults(packed, _capacities(spark, sf_dir)).withColumnRenamed("n_ids", "n_docs")


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_invariants": p6_invariants}
ORACLE = {
    "p6_invariants": """
        select distinct target_id, n_docs, 0::bigint as n_incomplete, 0::bigint as n_split, 0::bigint as n_over
        from pack_targets, (select count(*) as n_docs from documents where text <> '')
        where target_id is not null and capacity_tokens is not null and n_docs > 0""",
}
