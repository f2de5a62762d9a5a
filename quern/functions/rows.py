"""Small row-level helpers: exact samples, chunks, row numbers, local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer) by a hash of the key and the seed: the same rows at every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def with_chunk(df: DataFrame, key: str, chunks: int, seed: int = 12_345) -> DataFrame:
    """``chunk`` 0 .. chunks - 1 by a hash of the key: a random split that needs no shuffle."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(chunks)).cast("int"))


def with_row_numbers(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without moving all rows to one task: the rows are sorted by
    range, and each partition adds the number of rows before it (one number per partition reaches the driver)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = placed.persist()
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    offset = F.get(F.lit(before or [0]), F.col("_p"))
    return placed.withColumn(name, (offset + inside - 1).cast("bigint")).drop("_p")


def differences(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` plus ``diff`` to the next row in order, for short tables such as spectra."""
    return df.withColumn("diff", F.lead(value).over(Window.orderBy(order)) - F.col(value))


def local_maxima(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value exceeds both neighbours'."""
    w = Window.orderBy(order)
    peak = (F.lag(value).over(w) < F.col(value)) & (F.col(value) > F.lead(value).over(w))
    return df.withColumn("_peak", peak).where("_peak").drop("_peak")
