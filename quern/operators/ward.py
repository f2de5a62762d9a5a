"""Agglomerative clustering, cut for many numbers of clusters at once, and the elbow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import matrix

#: Nearest clusters that are remembered of each cluster, and distances that are held at once.
NEAR, HELD = 8, 4_000_000
#: Rows of one block of the distances of all rows.
ROWS_BLOCK = 8_000


def ward_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of Ward's method in ascending height. All pairs of clusters that are each other's nearest are merged at once,
    which gives the same tree as one merge at a time. Means and sizes tell the heights, so memory is linear in the rows;
    the arithmetic is quadratic. A merge brings no two clusters nearer, so what is not among the ``NEAR`` clusters found
    nearest stays beyond them, and only clusters that lost all of these (and new ones) are searched for again."""
    x = np.ascontiguousarray(x, float) + 0.0
    known: dict[bytes, int] = {}
    first = np.array([known.setdefault(row.tobytes(), i) for i, row in enumerate(x)], int)
    merges = [(int(a), i, 0.0) for i, a in enumerate(first) if a != i]
    name = np.unique(first)
    c, size = x[name], np.bincount(first)[name].astype(float) if len(x) else np.zeros(0)
    c -= c.mean(axis=0) if len(c) else 0
    n = left = len(c)
    square, share, level = (c * c).sum(axis=1), 1 / size, np.zeros(n)
    near, cost = np.zeros((n, NEAR), int), np.full((n, NEAR), np.inf)
    beyond, alive, todo = np.full(n, np.inf), np.ones(n, bool), np.arange(n)
    while left > 1:
        _search(c, square, share, todo, near, cost, beyond)
        at = cost.argmin(axis=1)
        best, height = near[np.arange(n), at], cost[np.arange(n), at]
        low = np.flatnonzero(alive & (best[best] == np.arange(n)) & (np.arange(n) < best))
        low = low if len(low) else np.array([np.argmin(np.where(alive, height, np.inf))])
        gone = best[low]
        level[low] = np.maximum(height[low], np.maximum(level[low], level[gone]))
        merges += [(*sorted((int(name[a]), int(name[b]))), float(h)) for a, b, h in zip(low, gone, level[low], strict=True)]
        name[low] = np.minimum(name[low], name[gone])
        total = size[low] + size[gone]
        c[low] = (c[low] * size[low, None] + c[gone] * size[gone, None]) / total[:, None]
        size[low], share[low], square[low] = total, 1 / total, (c[low] * c[low]).sum(axis=1)
        alive[gone], square[gone], cost[gone] = False, np.inf, np.inf
        left -= len(low)
        now, changed, fresh = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)
        now[gone], changed[low], changed[gone], fresh[low] = low, True, True, True
        rows, places = np.nonzero(changed[near] & np.isfinite(cost) & (alive & ~fresh)[:, None])
        to = now[near[rows, places]]
        for s in range(0, len(rows), 4_096):
            i, j = rows[s : s + 4_096], to[s : s + 4_096]
            off = c[i] - c[j]
            cost[i, places[s : s + 4_096]] = np.einsum("ij,ij->i", off, off) / (share[i] + share[j])
        near[rows, places] = to
        todo = np.flatnonzero(alive & (fresh | (cost.min(axis=1) > beyond)))
        if 2 * left < n:
            place = np.cumsum(alive) - 1
            todo, near = place[todo], place[near[alive]]
            c, square, share, size, level, name, cost, beyond = (v[alive] for v in (c, square, share, size, level, name, cost, beyond))
            n, alive = left, np.ones(left, bool)
    return sorted(merges, key=lambda m: m[2])


def _search(c: np.ndarray, square: np.ndarray, share: np.ndarray, todo: np.ndarray, near: np.ndarray, cost: np.ndarray, beyond: np.ndarray) -> None:
    """Fill in the ``NEAR`` nearest clusters of those in ``todo``, their heights and what no other one is below."""
    n = len(c)
    few = min(NEAR, n)
    step = max(1, HELD // n)
    for s in range(0, len(todo), step):
        i = todo[s : s + step]
        d = c[i] @ c.T
        d *= -2
        d += square
        d += square[i, None]
        np.maximum(d, 0, out=d)
        d /= share[i, None] + share
        d[np.arange(len(i)), i] = np.inf
        at = np.argpartition(d, few - 1, axis=1)[:, :few] if few < n else np.tile(np.arange(n), (len(i), 1))
        found = np.take_along_axis(d, at, axis=1)
        near[i[:, None], np.arange(few)], cost[i[:, None], np.arange(few)] = at, found
        cost[i, few:] = np.inf
        beyond[i] = found.max(axis=1) if few < n else np.inf


def cut(n: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels 0.. of ``k`` clusters, numbered by their first row."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in merges[: max(0, n - k)]:
        parent[root(b)] = root(a)
    roots = np.array([root(i) for i in range(n)])
    _, first, label = np.unique(roots, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def ward_labels(points: DataFrame, ks: range, max_rows: int | None = None) -> DataFrame:
    """``(k, id, cluster)`` of ``points`` (``id``, ``vector``) for every k, in one task that holds the vectors but not their
    distances. More than ``max_rows`` rows, where given, raise; :mod:`quern.operators.bfr` needs no quadratic arithmetic."""
    rows = points.select("id", "vector")
    rows = rows if max_rows is None else rows.limit(max_rows + 1)
    kind = points.schema["id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        if max_rows is not None and len(group) > max_rows:
            raise ValueError(f"more than {max_rows} rows")
        group = group.sort_by("id")
        ids, n = group.column("id").combine_chunks(), len(group)
        merges = ward_merges(matrix(group.column("vector")))
        given = [k for k in ks if k <= n]
        labels = [cut(n, merges, k) for k in given]
        return pa.table({
            "k": np.repeat(np.array(given, np.int32), n),
            "id": pa.concat_arrays([ids] * len(given)) if given else ids.slice(0, 0),
            "cluster": np.concatenate([np.zeros(0, np.int32), *labels]).astype(np.int32),
        })

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(run, f"k int, id {kind}, cluster int")


def distance_row_metrics(points: DataFrame, cluster: str, block: int = ROWS_BLOCK) -> DataFrame:
    """``(cluster, size, radius, diameter, density)`` in the space of the points' rows of distances to all points: diameter is
    the largest distance of a member to any point, radius the largest gap in any place between a member's row and the
    mean of the members' rows, density members times points over the diameter (null where that is 0). These numbers
    describe the whole set rather than the cluster, for which there is :func:`quern.operators.vectors.cluster_metrics`.

    Rows (``id`` tells them apart) are cut into blocks, and each pair of blocks is a task that holds 256 rows of distances and
    returns per point and cluster the number, sum, least and largest of the distances to the cluster's members. A row
    is sent to as many tasks as there are blocks; the arithmetic is quadratic."""
    rows = points.select("id", "vector", F.col(cluster).alias("cluster"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    spread = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = spread.select("id", "cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "vector")

    def run(group: pa.Table) -> pa.Table:
        x = matrix(group.column("vector"))
        x -= x.mean(axis=0)
        own, names = group.column("own").to_numpy(), group.column("cluster").to_pylist()
        codes = {v: i for i, v in enumerate(dict.fromkeys(names))}
        part = np.array([codes[v] for v in names])
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        left, right = (at[np.argsort(part[at], kind="stable")] for at in (np.flatnonzero(own == a), np.flatnonzero(own == b)))
        count = np.zeros((len(codes), len(x)), int)
        total, low, high = np.zeros(count.shape), np.full(count.shape, np.inf), np.full(count.shape, -np.inf)

        def note(apart: np.ndarray, members: np.ndarray, to: np.ndarray) -> None:
            starts = np.flatnonzero(np.diff(part[members], prepend=-1))
            at = np.ix_(part[members][starts], to)
            count[at] += np.diff(starts, append=len(members))[:, None]
            total[at] += np.add.reduceat(apart, starts, axis=0)
            low[at] = np.minimum(low[at], np.minimum.reduceat(apart, starts, axis=0))
            high[at] = np.maximum(high[at], np.maximum.reduceat(apart, starts, axis=0))

        for s in range(0, len(left) if len(right) else 0, 256):
            apart = _apart(x, left[s : s + 256], right)
            note(apart, left[s : s + 256], right)
            if a != b:
                note(np.ascontiguousarray(apart.T), right, left[s : s + 256])
        of, to = np.nonzero(count)
        return pa.table({
            "id": group.column("id").combine_chunks().take(pa.array(to)),
            "cluster": pa.array([*codes], group.schema.field("cluster").type).take(pa.array(of)),
            "n": count[of, to], "total": total[of, to], "low": low[of, to], "high": high[of, to],
        })

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = tasks.groupBy("a", "b").applyInArrow(run, f"id {kinds['id']}, cluster {kinds['cluster']}, n bigint, total double, low double, high double")
    places = found.where("cluster is not null").groupBy("cluster", "id").agg(
        F.sum("n").alias("size"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    out = places.groupBy("cluster").agg(
        F.max("size").alias("size"), F.max(F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))).alias("radius"), F.max("high").alias("diameter")
    )
    return out.withColumn("density", F.try_divide(F.col("size").cast("double") * n, F.col("diameter")))


def _apart(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x``; those so small that their products cancel are taken anew."""
    y, z = x[left], x[right]
    out = y @ z.T
    out *= -2
    bound = (y * y).sum(axis=1)[:, None] + (z * z).sum(axis=1)
    out += bound
    i, j = np.nonzero(out < 1e-6 * bound)
    for s in range(0, len(i), 4_096):
        off = y[i[s : s + 4_096]] - z[j[s : s + 4_096]]
        out[i[s : s + 4_096], j[s : s + 4_096]] = np.einsum("ij,ij->i", off, off)
    return np.sqrt(np.maximum(out, 0, out=out), out=out)


def elbow(metrics: DataFrame) -> DataFrame:
    """``(k, mean_diameter, relative_drop)`` from ``(k, diameter)`` rows; the drop is towards the next k. The k of the
    smallest drop is where more clusters help least."""
    means = metrics.groupBy("k").agg(F.avg("diameter").alias("mean_diameter"))
    later = F.lead("mean_diameter").over(Window.orderBy("k"))
    return means.withColumn("relative_drop", F.try_divide(F.col("mean_diameter") - later, F.col("mean_diameter")))
