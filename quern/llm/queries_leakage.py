"""Queries for evaluation texts leaking into the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.leakage import leaked_items
from quern.sources.tables import table


def _leaks(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaked_items(docs, table(spark, sf_dir, "eval_items").select("item_id", "text"), **how)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 20 words with at most one word inserted, deleted or replaced."""
    return _leaks(spark, sf_dir, max_edits=1)


QUERIES = {"p7_found": p7_found, "p7_edited": p7_edited}

_RUNS = r"""
    with r as (select {id} as id, unnest([array_to_string(w[i:i+19], ' ') for i in range(1, len(w) - 18)]) as run
               from (select {id}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w
                     from {t}) where len(w) >= 20) select distinct id, run from r"""

ORACLE = {
    "p7_found": f"""
        select distinct d.id as doc_id, i.id as item_id
        from ({_RUNS.format(id="doc_id", t="documents")}) d join ({_RUNS.format(id="item_id", t="eval_items")}) i using (run)""",
}
