"""Approximate counting of ones in the latest part of a bit stream with exponentially growing buckets.

Streams are keyed and independent. A batch table is repartitioned by key, sorted by key and position and folded in one
pass, with one state at a time in memory; a stream keeps the state of each key in the state store, so a restart goes on
where it stopped and micro-batch boundaries don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MODES = ("canonical", "compat")


class Dgim:
    """State of one stream: buckets ``(time, size)``, newest first.

    ``canonical``: at most two buckets of a size; of three the two oldest merge, under the later time, as often as
    needed; buckets that left the window go; the count is the sum less half the oldest bucket. Times are kept within
    ``window``, counts asked for the last ``window`` bits.

    ``compat``: after a one, of the first three buckets in a row of equal size the newest goes and the oldest doubles
    under its own time; after every merge, and after every bit as long as there are more than two buckets, the oldest takes
    half the size of its newer neighbour if it is older than ``k`` bits, and goes if it left the window, one per bit; the
    count is the plain sum.
    """

    def __init__(self, window: int, k: int, mode: str = "canonical", now: int = 0, ones: int = 0, buckets: Iterable = ()):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.window, self.k, self.mode = window, k, mode
        self.now, self.ones = now, ones
        self.buckets: list[list[int]] = [list(b) for b in buckets]

    def update(self, bit: int) -> None:
        self.now += 1
        self.ones += bit
        if self.mode == "canonical":
            self._canonical(bit)
        else:
            self._compat(bit)

    def extend(self, bits: np.ndarray) -> None:
        """:meth:`update` with each of the bits; zeros only move the clock on in canonical mode."""
        if self.mode != "canonical":
            for b in bits.tolist():
                self.update(b)
            return
        begin = self.now
        for at in (np.flatnonzero(bits) + 1).tolist():
            self.now = begin + at
            self._canonical(1)
        self.now = begin + len(bits)
        self.ones += int(bits.sum())
        self._canonical(0)

    def count(self) -> int:
        total = sum(size for _, size in self.buckets)
        if self.mode == "canonical" and self.buckets:
            total -= self.buckets[-1][1] // 2
        return total

    def _canonical(self, bit: int) -> None:
        b = self.buckets
        while b and b[-1][0] <= self.now - self.window:
            b.pop()
        if not bit:
            return
        b.insert(0, [self.now, 1])
        at = 0
        while at + 2 < len(b) and b[at][1] == b[at + 1][1] == b[at + 2][1]:
            b[at + 1 : at + 3] = [[b[at + 1][0], 2 * b[at + 1][1]]]
            at += 1

    def _compat(self, bit: int) -> None:
        rows = [[self.now, 1]] * bit + self.buckets
        equal = [i for i, three in enumerate(zip(rows, rows[1:], rows[2:], strict=False)) if len({size for _, size in three}) == 1]
        if equal and bit:
            time, size = rows[equal[0] + 2]
            rows[equal[0] : equal[0] + 3] = [rows[equal[0] + 1], [time, 2 * size]]
        if len(rows) > 2 or equal and bit:
            time = rows[-1][0]
            if self.now - time >= self.k - 1:
                rows[-1] = [time, rows[-2][1] // 2]
            if self.now - time >= self.window and len(rows) > 2:
                rows.pop()
        self.buckets = rows


def dgim_batch(bits: DataFrame, key: str, order: str, bit: str, window: int, k: int, mode: str = "canonical") -> DataFrame:
    """``(key, n_bits, ones, estimate)`` at the end of each key's stream. Rows with a null key, order or bit are left
    out; equal positions are taken in the order of the bit. The rows of a key stay in one task, as a stream is
    sequential, but only its state is held."""
    rows = bits.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(bit).cast("int").alias("bit")).dropna()
    kind = rows.schema["key"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            keys, ones = batch.column("key"), batch.column("bit").to_numpy()
            runs = pc.run_end_encode(keys)
            begin = 0
            for x, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if state is None or x != current:
                    if state is not None:
                        done.append((current, state.now, state.ones, state.count()))
                    current, state = x, Dgim(window, k, mode)
                state.extend(ones[begin:end])
                begin = end
        if state is not None:
            done.append((current, state.now, state.ones, state.count()))
        if done:
            keys, n, ones, estimate = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field("key").type), pa.array(n, pa.int64()), pa.array(ones, pa.int64()), pa.array(estimate, pa.int64())],
                names=["key", "n_bits", "ones", "estimate"],
            )

    placed = rows.repartition("key").sortWithinPartitions("key", "at", "bit")
    return placed.mapInArrow(fold, f"key {kind}, n_bits bigint, ones bigint, estimate bigint")


def dgim_stream(bits: DataFrame, key: str, order: str, bit: str, window: int, k: int, mode: str = "canonical") -> DataFrame:
    """The streaming twin: after every micro-batch one row ``(key, t_start, t_end, estimate, ones)`` per key with new
    bits, in update mode. Bits of one micro-batch are taken by ``order``; later micro-batches must not go back."""
    rows = bits.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("at"), F.col(bit).cast("int").alias("bit")).dropna()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, ones, times, sizes = held.get if held.exists else (0, 0, [], [])
        state = Dgim(window, k, mode, now, ones, zip(times, sizes, strict=True))
        new = pd.concat(list(frames)).sort_values(["at", "bit"])
        state.extend(new["bit"].to_numpy())
        held.update((state.now, state.ones, [t for t, _ in state.buckets], [s for _, s in state.buckets]))
        yield pd.DataFrame(
            {"key": [keys[0]], "t_start": [int(new["at"].min())], "t_end": [int(new["at"].max())], "estimate": [state.count()], "ones": [state.ones]}
        )

    return rows.groupBy("key").applyInPandasWithState(
        step,
        "key string, t_start bigint, t_end bigint, estimate bigint, ones bigint",
        "now bigint, ones bigint, times array<bigint>, sizes array<bigint>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def exact_ones(bits: DataFrame, key: str, order: str, bit: str, window: int) -> DataFrame:
    """``(key, exact)``: ones among the last ``window`` bits of each key, for comparison."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = bits.select(key, order, bit).dropna().withColumn("_n", last).where(F.col("_n") <= window)
    return rows.groupBy(F.col(key).alias("key")).agg(F.sum(F.col(bit).cast("bigint")).alias("exact"))
