"""Tables of a dataset folder and their cleaned views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.parse import integer_text, same_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def condition_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(patient string, code bigint)`` of every row of ``conditions``; either may be null."""
    return table(spark, sf_dir, "conditions").select(
        same_id("patient").alias("patient"), integer_text("code").alias("code")
    )


def track_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track_id bigint, feature array<float>)`` of the rows of ``features`` whose track_id is readable."""
    rows = table(spark, sf_dir, "features").select(integer_text("track_id").alias("track_id"), "feature")
    return rows.where(F.col("track_id").isNotNull())
