"""Clustering of vectors that are read once, chunk by chunk, with bounded summaries.

The state is a number of clusters' summaries (count, sum, sum of squares per dimension): the discard set of ``k``
clusters, and the compression set of mini clusters of points that were near none of them. It is small whatever the
number of rows and lives on the driver; every pass over rows is a distributed projection followed by a summary per
cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.vectors import summaries
from quern.session import cut_lineage, shared_folder

SEED = 12_345
MINI_SEEDS = 10


@dataclass
class Summary:
    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Summary:
        return cls(np.zeros(0), np.zeros((0, width)), np.zeros((0, width)))

    @classmethod
    def of(cls, points: np.ndarray) -> Summary:
        return cls(np.ones(len(points)), points.copy(), points**2)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n[:, None]

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.square / self.n[:, None] - self.mean**2, 0))

    def add(self, rows: list, shift: int = 0) -> None:
        for r in rows:
            i = r["cluster"] - shift
            self.n[i] += r["n"]
            self.total[i] += r["sum"]
            self.square[i] += r["sumsq"]

    def take(self, keep: np.ndarray) -> Summary:
        return Summary(self.n[keep], self.total[keep], self.square[keep])

    def join(self, other: Summary) -> Summary:
        return Summary(*(np.concatenate([a, b]) for a, b in ((self.n, other.n), (self.total, other.total), (self.square, other.square))))


def distances(x: np.ndarray, s: Summary) -> tuple[np.ndarray, bool]:
    """Distance of each row to each cluster, and whether it is in deviations: as long as a cluster has a single member
    all distances are Euclidean. A deviation of 0 in any dimension makes the distance infinite."""
    if (s.n < 2).any():
        return np.stack([np.linalg.norm(x - m, axis=1) for m in s.mean], axis=1), False
    out = np.empty((len(x), len(s.n)))
    for j, (m, d) in enumerate(zip(s.mean, s.deviation, strict=True)):
        out[:, j] = np.inf if (d == 0).any() else np.sqrt((((x - m) / d) ** 2).sum(axis=1))
    return out, True


def assign(points: DataFrame, state: Summary, threshold: float | None) -> DataFrame:
    """``(id, vector, cluster)``: the nearest cluster (ties: the smaller number), null beyond ``threshold`` where
    distances are in deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            d, scaled = distances(x, state)
            best = np.argmin(d, axis=1)
            far = np.zeros(len(x), bool)
            if scaled and threshold is not None:
                far = ~(d[np.arange(len(x)), best] <= threshold)
            cluster = pa.array(best.astype(np.int32), mask=far)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), cluster], names=["id", "vector", "cluster"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "vector").mapInArrow(run, f"id {kind}, vector array<double>, cluster int")


@dataclass
class Bfr:
    """``discard``: summaries of the k clusters; ``compressed``: of the mini clusters; ``assignments``:
    ``(id, kind, cluster)`` of every point with kind ``discard``, ``compressed`` or ``retained``."""

    discard: Summary
    compressed: Summary
    assignments: DataFrame
    parts: list[DataFrame] = field(default_factory=list)


def _seeds(points: DataFrame, n: int) -> tuple[list, np.ndarray]:
    rows = points.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(n).collect()
    return [r["id"] for r in rows], np.array([r["vector"] for r in rows])


def merge_close(s: Summary, limit: float) -> tuple[Summary, np.ndarray]:
    """Merge pairs of mini clusters while the mean deviation of the union stays within ``limit`` times that of the
    parts; the second result maps old to new numbers."""
    target = np.arange(len(s.n))
    merged = True
    while merged and len(s.n) > 1:
        merged = False
        for i in range(len(s.n)):
            for j in range(i + 1, len(s.n)):
                both = Summary(*(np.array([a[i] + a[j]]) for a in (s.n, s.total, s.square)))
                if both.deviation.mean() <= limit * max(s.deviation[i].mean(), s.deviation[j].mean()):
                    s.n[i], s.total[i], s.square[i] = both.n[0], both.total[0], both.square[0]
                    target[target == j] = i
                    target[target > j] -= 1
                    s = s.take(np.arange(len(s.n)) != j)
                    merged = True
                    break
            if merged:
                break
    return s, target


def bfr(points: DataFrame, k: int, threshold: float, chunks: int = 10, merge_limit: float = 1.2) -> Bfr | None:
    """Cluster ``points`` (``id``, ``vector`` without nulls, equal widths). None for an empty table.

    Seeds are the first ``k`` points by a hash of the id, chunks are by hash too, so the same table always gives the
    same result. Points of a chunk that are within ``threshold`` deviations of a cluster join it; the others are
    gathered around up to ten of them, groups of one are retained as single points, and the mini clusters of all chunks
    are merged at the end where that keeps them tight. Rows are written by chunk and again once they are assigned.
    """
    ids, seeds = _seeds(points, k)
    if not ids:
        return None
    # Written by chunk, so that each chunk reads its own rows only.
    place = shared_folder(points.sparkSession)
    rest = points.where(~F.col("id").isin(ids)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    rest.select("id", "vector", "chunk").write.partitionBy("chunk").parquet(place)
    rest = points.sparkSession.read.schema(rest.select("id", "vector", "chunk").schema).parquet(place)
    discard, compressed = Summary.of(seeds), Summary.empty(seeds.shape[1])
    found = [points.where(F.col("id").isin(ids)).select("id", F.lit("discard").alias("kind"), _seed_number(ids).alias("cluster"))]
    for c in range(chunks):
        state = Summary(discard.n.copy(), discard.total.copy(), discard.square.copy())
        chunk = cut_lineage(assign(rest.where(F.col("chunk") == c), state, threshold))
        near, far = chunk.where("cluster is not null"), chunk.where("cluster is null")
        discard.add(summaries(near, "cluster").collect())
        found.append(near.select("id", F.lit("discard").alias("kind"), "cluster"))
        far_ids, mini = _seeds(far, MINI_SEEDS)
        if not far_ids:
            continue
        grouped = assign(far.drop("cluster"), Summary.of(mini), None)
        sums = {r["cluster"]: r for r in summaries(grouped, "cluster").collect()}
        kept = sorted(i for i, r in sums.items() if r["n"] > 1)
        number = {old: len(compressed.n) + new for new, old in enumerate(kept)}
        for i in kept:
            r = sums[i]
            compressed = compressed.join(Summary(np.array([float(r["n"])]), np.array([r["sum"]]), np.array([r["sumsq"]])))
        known = F.lit(None).cast("int")
        for old, new in number.items():
            known = F.when(F.col("cluster") == old, F.lit(new)).otherwise(known)
        found.append(grouped.select("id", F.when(F.col("cluster").isin(kept), "compressed").otherwise("retained").alias("kind"), known.alias("cluster")))
    compressed, target = merge_close(compressed, merge_limit)
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    moved = F.when(F.col("kind") == "compressed", F.get(F.lit(target.tolist() or [0]), F.col("cluster"))).otherwise(F.col("cluster"))
    return Bfr(discard, compressed, union.withColumn("cluster", moved.cast("int")))


def _seed_number(ids: list):
    out = F.lit(None).cast("int")
    for i, x in enumerate(ids):
        out = F.when(F.col("id") == x, F.lit(i)).otherwise(out)
    return out


def summary_rows(spark, result: Bfr) -> DataFrame:
    """``(kind, cluster, n, mean_deviation)`` of the clusters of both sets."""
    rows = [
        (kind, i, int(s.n[i]), float(s.deviation[i].mean()))
        for kind, s in (("discard", result.discard), ("compressed", result.compressed))
        for i in range(len(s.n))
    ]
    return spark.createDataFrame(rows, "kind string, cluster int, n bigint, mean_deviation double")
