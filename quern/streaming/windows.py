"""Windowed and decaying counts of events; the same expressions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_counts(
    events: DataFrame, ts: str, event: str, size: str, slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    """``(start, end, event, n)`` per window and event; tumbling windows without ``slide``. Rows with a null time or
    event are left out. On a stream, ``watermark`` bounds the state and allows append mode; without it every window is
    kept."""
    return _windowed(events, ts, event, size, slide, watermark, F.count(F.lit(1)).alias("n"))


def decayed_counts(
    events: DataFrame, ts: str, event: str, size: str, slide: str, decay: float, by_age: bool, watermark: str | None = None
) -> DataFrame:
    """``(start, end, event, weight)`` rounded to four digits.

    ``by_age=False``: every event weighs ``1 * (1 - decay) + 1``, whatever its age. ``by_age=True``: an event weighs
    ``(1 - decay) ^ (seconds to the end of the window)``.
    """
    if by_age:
        age = F.unix_micros(F.col("_w.end").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
        weight = F.pow(F.lit(1 - decay), age / F.lit(1e6))
    else:
        weight = F.lit(1) * F.lit(1 - decay) + F.lit(1)
    return _windowed(events, ts, event, size, slide, watermark, F.round(F.sum(weight), 4).alias("weight"))


def _windowed(
    events: DataFrame, ts: str, event: str, size: str, slide: str | None, watermark: str | None, result: Column
) -> DataFrame:
    rows = events.where(F.col(ts).isNotNull() & F.col(event).isNotNull()).select(F.col(ts), F.col(event))
    if watermark:
        # Times without a zone can't carry a watermark.
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = rows.withColumn("_w", window).groupBy("_w", event).agg(result)
    return counted.select(
        F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), F.col(event).alias("event"), counted.columns[-1]
    )
