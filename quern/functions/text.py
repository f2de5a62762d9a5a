"""Text expressions: words, word runs, shingle hashes. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(c: Column | str) -> Column:
    """Maximal runs of letters and digits of the lower-cased text; null for null, empty array for no word."""
    return F.array_remove(F.split(F.lower(c), NOT_WORD), "")


def word_hashes(c: Column | str) -> Column:
    """64-bit hash of each word of an array of words."""
    return F.transform(c, lambda w: F.xxhash64(w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, wherever the optimizer moves the expression. Without
    this, a filter pushed below a projection would evaluate an array anew for each element that refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_hashes(hashes: Column, k: int) -> Column:
    """One hash per run of ``k`` consecutive words, in order, from the array of word hashes; empty array where there
    are fewer than ``k`` words, null for null."""

    def runs(h: Column) -> Column:
        def run(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + j) for j in range(k)])

        some = F.transform(F.sequence(F.lit(0), F.size(h) - k), run)
        return F.when(h.isNull(), None).when(F.size(h) >= k, some).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, runs)
