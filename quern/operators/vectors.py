"""Aggregates and distances over vectors: summaries, centroids, standardisation, nearest centroid, cluster metrics.

Vectors are summed by the ML summarizer, one aggregate buffer per group and task, so a vector is never exploded and a
hot cluster is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import as_doubles, euclidean, mahalanobis_diagonal, matrix

#: Rows of one block of the exact diameter.
DIAMETER_BLOCK = 8_000


def clean_vectors(df: DataFrame, row_id: str, vector: str, width: int, *keep: str) -> DataFrame:
    """``(id, vector array<double>, *keep)`` of the rows with an id and exactly ``width`` finite elements."""
    v = as_doubles(vector)
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(row_id).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(row_id).alias("id"), v.alias("vector"), *keep
    )


def summaries(points: DataFrame, cluster: str) -> DataFrame:
    """``(cluster, n, sum, sumsq)`` of ``points`` (``vector``), element by element."""
    stats = Summarizer.metrics("count", "sum", "normL2").summary(array_to_vector("vector"))
    out = points.groupBy(F.col(cluster).alias("cluster")).agg(stats.alias("s"))
    norms = vector_to_array("s.normL2")
    return out.select(
        "cluster",
        F.col("s.count").alias("n"),
        vector_to_array("s.sum").alias("sum"),
        F.transform(norms, lambda x: x * x).alias("sumsq"),
    )


def mean_and_deviation(summary: DataFrame) -> DataFrame:
    """``(cluster, n, mean, stdev)`` with the population deviation sumsq/n - mean^2, not below 0."""
    mean = F.transform("sum", lambda x: x / F.col("n"))
    with_mean = summary.withColumn("mean", mean)
    spread = F.zip_with("sumsq", "mean", lambda q, m: F.sqrt(F.greatest(q / F.col("n") - m * m, F.lit(0.0))))
    return with_mean.select("cluster", "n", "mean", spread.alias("stdev"))


def merge_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise sum of the summaries of equal cluster numbers."""
    both = a.unionByName(b)
    add = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c)))
    return both.groupBy("cluster").agg(F.sum("n").alias("n"), add(F.col("sum")).alias("sum"), add(F.col("sumsq")).alias("sumsq"))


def standardised(points: DataFrame) -> DataFrame:
    """``vector`` replaced by (x - mean) / population deviation of its place over all points; 0 where the deviation is
    0. One summary row is broadcast."""
    whole = mean_and_deviation(summaries(points.withColumn("_all", F.lit(0)), "_all")).select("mean", "stdev")
    scaled = F.zip_with(
        F.zip_with("vector", "mean", lambda x, m: x - m), "stdev", lambda d, s: F.coalesce(F.try_divide(d, s), F.lit(0.0))
    )
    return points.crossJoin(F.broadcast(whole)).withColumn("vector", scaled).drop("mean", "stdev")


def distance_to_center(points: DataFrame, cluster: str, few: bool = False) -> DataFrame:
    """``points`` plus ``euclid`` and ``mahalanobis`` to the mean of the point's own cluster. The clusters' means are
    bounded by their number and joined by it; those of ``few`` clusters are broadcast, so that no point is shuffled."""
    centers = mean_and_deviation(summaries(points, cluster)).select(F.col("cluster").alias(cluster), "mean", "stdev")
    joined = points.join(F.broadcast(centers) if few else centers, cluster)
    return joined.withColumn("euclid", euclidean(F.col("vector"), F.col("mean"))).withColumn(
        "mahalanobis", mahalanobis_diagonal(F.col("mean"), F.col("stdev"), F.col("vector"))
    ).drop("mean", "stdev")


def _nearest(points: DataFrame, centers: list[tuple[int, list[float]]], inverse: np.ndarray | None) -> DataFrame:
    """``(id, center, distance)``: the nearest center under a quadratic form, Euclidean where it is None. Centers travel with
    the task's code and points are never shuffled."""
    names = np.array([i for i, _ in sorted(centers)])
    at = np.array([c for _, c in sorted(centers)], float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            square = np.empty((len(x), len(at)))
            for j, c in enumerate(at):
                off = x - c
                square[:, j] = np.einsum("ij,ij->i", off if inverse is None else off @ inverse, off)
            best = np.argmin(square, axis=1)
            distance = np.sqrt(np.maximum(square[np.arange(len(x)), best], 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[best].astype(np.int32)), pa.array(distance)], names=["id", "center", "distance"]
            )

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "vector").mapInArrow(nearest, f"id {kind}, center int, distance double")


def nearest_center(points: DataFrame, centers: list[tuple[int, list[float]]]) -> DataFrame:
    """``(id, center, distance)`` of the nearest of the given centers (ties: the smaller number)."""
    return _nearest(points, centers, None)


def mahalanobis_to_centers(points: DataFrame, centers: list[tuple[int, list[float]]]) -> DataFrame:
    """``(id, center, distance)`` of the nearest center under the pseudo-inverse of the centers' own covariance. The
    matrix is as large as the vectors are wide, whatever the number of points."""
    return _nearest(points, centers, np.linalg.pinv(np.atleast_2d(np.cov([c for _, c in centers], rowvar=False))))


def diameters(points: DataFrame, cluster: str, block: int = DIAMETER_BLOCK) -> DataFrame:
    """``(cluster, diameter)``: the exact largest distance between two members.

    A cluster of m rows is cut into ceil(m / block) blocks, and each pair of blocks is a task that returns one number: no
    pair of points becomes a row and no task holds more than two blocks. A row is sent to as many tasks as its cluster
    has blocks, and the arithmetic is quadratic in m.
    """
    return _farthest(points.withColumn("_cell", F.lit(0)), cluster, "_cell", block).groupBy("cluster").agg(F.max("far").alias("diameter"))


def nested_diameters(points: DataFrame, whole: str, cell: str, members: DataFrame, block: int = DIAMETER_BLOCK) -> DataFrame:
    """``(cluster, diameter)`` of clusters that are each made of cells, as the cuts of one tree are: ``members`` has the
    ``(cluster, cell)`` rows, ``points`` the ``cell`` of each point and a coarsest cluster, ``whole``, across which nothing is
    asked for. A pair of points is compared once, for all clusters that hold it."""
    far = _farthest(points, whole, cell, block).groupBy("x", "y").agg(F.max("far").alias("far"))
    x, y = (members.select("cluster", F.col("cell").alias(c)) for c in ("x", "y"))
    return far.join(F.broadcast(x), "x").join(F.broadcast(y), ["cluster", "y"]).groupBy("cluster").agg(F.max("far").alias("diameter"))


def _farthest(points: DataFrame, cluster: str, cell: str, block: int) -> DataFrame:
    """``(cluster, x, y, far)``: the largest distance between a member of cell x and one of cell y of the same cluster, in
    the pairs of blocks of the cluster; x and y in either order."""
    sizes = points.groupBy(F.col(cluster).alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    numbered = points.select(F.col(cluster).alias("cluster"), F.col(cell).alias("cell"), "id", "vector").join(sizes, "cluster")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    spread = numbered.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = spread.select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cell", "vector")

    def farthest(group: pa.Table) -> pa.Table:
        x = matrix(group.column("vector"))
        own = group.column("own").to_numpy()
        names, at = np.unique(group.column("cell").to_numpy(zero_copy_only=False), return_inverse=True)
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        left, right = (i[np.argsort(at[i], kind="stable")] for i in (np.flatnonzero(own == a), np.flatnonzero(own == b)))
        best = np.full((len(names), len(names)), -1.0)
        for s in range(0, len(left) if len(right) else 0, 256):
            rows, others = left[s : s + 256], right[s:] if a == b else right
            part, rest = x[rows], x[others]
            square = (part * part).sum(1)[:, None] + (rest * rest).sum(1) - 2 * part @ rest.T
            down, over = (np.flatnonzero(np.diff(at[i], prepend=-1, append=-1)) for i in (rows, others))
            for t, u in zip(down[:-1], down[1:], strict=True):
                for v, w in zip(over[:-1], over[1:], strict=True):
                    own_part = square[t:u, v:w]
                    i, j = np.unravel_index(np.argmax(own_part), own_part.shape)
                    pair = at[rows[t]], at[others[v]]
                    best[pair] = max(best[pair], float(np.linalg.norm(part[t + i] - rest[v + j])))
        i, j = np.nonzero(best >= 0)
        named = pa.array(names, group.schema.field("cell").type)
        return pa.table({"cluster": group.column("cluster").combine_chunks().take(pa.array(np.zeros(len(i), int))), "x": named.take(pa.array(i)), "y": named.take(pa.array(j)), "far": best[i, j]})

    kind, inner = points.schema[cluster].dataType.simpleString(), tasks.schema["cell"].dataType.simpleString()
    return tasks.groupBy("cluster", "a", "b").applyInArrow(farthest, f"cluster {kind}, x {inner}, y {inner}, far double")


def cluster_metrics(points: DataFrame, cluster: str, far: DataFrame | None = None) -> DataFrame:
    """``(cluster, size, radius, diameter, density)``: radius is the largest distance of a member to the mean, density
    is size / radius^2; a cluster of one member has 0 in all three. ``far``: the ``(cluster, diameter)`` of few clusters, if
    they are known; their means are then broadcast."""
    radius = distance_to_center(points, cluster, far is not None).groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.max("euclid").alias("radius")
    )
    density = F.coalesce(F.try_divide(F.col("size").cast("double"), F.col("radius") * F.col("radius")), F.lit(0.0))
    far = diameters(points, cluster) if far is None else far
    return radius.join(far, "cluster").select("cluster", "size", "radius", "diameter", density.alias("density"))


def top_value_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, n)``: the most frequent non-null value of each non-null group; ties: the smaller value. Rows are
    counted before anything is ranked."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("value")))
    return counts.groupBy(group).agg(best.alias("b")).select(group, F.col("b.value").alias(value), (-F.col("b.minus")).alias("n"))
