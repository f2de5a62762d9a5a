"""Per-key results where a few keys own most rows.

A mergeable frequent-item sketch names the heavy keys in one pass without a shuffle of the rows. Rows of heavy keys
are spread over salts and meet the other side by broadcast (at most ``1 / min_share`` keys, so the broadcast has a
bound that does not grow with the data); all other rows take the ordinary shuffle; the two results are united.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Most bytes (as text) of the other side that are broadcast for the heavy keys.
BROADCAST_BYTES = 32 << 20


def heavy_keys(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """Keys that may hold at least ``min_share`` of the rows with a non-null key, as one column named as ``key``.

    The sketch misses no such key but may name others: at most ``ceil(1 / min_share)`` keys come out. They are fetched
    here, once: another evaluation may merge the sketches in another order and name other keys besides, and every use
    must see the same ones. An empty table or one with only null keys gives no row.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be in (0, 1]")
    kind = df.schema[key].dataType
    # The sketch tells binary values apart by their place in memory.
    value = F.hex(key) if isinstance(kind, BinaryType) else F.col(key)
    rows = df.select(value.alias("k")).where("k is not null")
    named = rows.stat.freqItems(["k"], min_share * 0.999).first()[0]
    keys = [(bytearray.fromhex(k) if isinstance(kind, BinaryType) else k,) for k in dict.fromkeys(named)]
    return df.sparkSession.createDataFrame(keys, StructType([StructField(key, kind)]))


def _mark(df: DataFrame, key: str, heavy: DataFrame, flag: str) -> DataFrame:
    keys = heavy.select(F.col(key).alias("_heavy_key")).distinct()
    return df.join(F.broadcast(keys), F.col(key) == F.col("_heavy_key"), "left").withColumn(
        flag, F.col("_heavy_key").isNotNull()
    ).drop("_heavy_key")


def skew_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    final: dict[str, Callable[[str], Column]],
    min_share: float = 0.01,
    salts: int = 64,
) -> DataFrame:
    """One row per non-null key with ``key``, ``heavy`` (named by the sketch) and the aggregates.

    ``partial`` gives aggregates over rows, ``final`` how partial results of the same name combine (``F.sum``,
    ``F.min``, ...). Rows of heavy keys are aggregated by (key, salt) first, so no task holds more than ``1/salts`` of
    a key. Empty input gives no row.
    """
    keyed = _mark(df.where(F.col(key).isNotNull()), key, heavy_keys(df, key, min_share), "heavy")
    salt = F.when(F.col("heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)
    # The mark is an aggregate and no grouping key: a filter on it stays above the shuffle, so that both branches read
    # the same shuffled rows and the table is scanned once.
    first = keyed.withColumn("_salt", salt).groupBy(key, "_salt").agg(
        F.bool_or("heavy").alias("heavy"), *[c.alias(n) for n, c in partial.items()]
    )
    heavy = first.where("heavy").groupBy(key, "heavy").agg(*[final[n](n).alias(n) for n in partial])
    return first.where("not heavy").drop("_salt").unionByName(heavy)


def skew_distinct_counts(df: DataFrame, key: str, value: str, min_share: float = 0.01) -> DataFrame:
    """``(key, n_distinct)``: distinct non-null values per non-null key. The rows are first reduced to distinct
    (key, value), which spreads a heavy key by its values; a key with only null values has 0."""
    pairs = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("_one"))
    return skew_aggregate(pairs, key, {"n_distinct": F.count(value)}, {"n_distinct": F.sum}, min_share).drop("heavy")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    min_share: float = 0.01,
    salts: int = 32,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join on ``key`` (``inner`` or ``left``) where ``left`` is skewed.

    Right rows of the heavy keys are broadcast if they hold at most ``broadcast_bytes``; beyond that they are
    replicated over ``salts`` and joined with the salted left rows by shuffle. Remaining keys join by ordinary
    shuffle. Null keys never match and stay with ``left``. Other columns that both sides have come out twice in the
    order left, right only if the caller renames them; a clash raises.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"rename columns that both sides have: {sorted(clash)}")
    heavy = heavy_keys(left, key, min_share)
    marked = _mark(left, key, heavy, "_heavy")
    hot_right = right.join(F.broadcast(heavy.distinct()), key, "left_semi")
    hot, rest = marked.where("_heavy").drop("_heavy"), marked.where("not _heavy").drop("_heavy")
    held = hot_right.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if held <= broadcast_bytes:
        joined = hot.join(F.broadcast(hot_right), key, how)
    else:
        spread = hot.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        copies = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = spread.join(copies, [key, "_salt"], how).drop("_salt")
    return rest.join(right, key, how).unionByName(joined)
