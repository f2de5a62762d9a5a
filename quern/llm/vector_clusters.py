"""Similarity clusters of vectors and their medoids.

Density clustering: a vector is a core point if at least ``min_points`` others reach the threshold; core points that
reach it are linked, a cluster is a largest set of core points linked directly or through others, and a vector that is
no core point joins the smallest cluster of its core partners. With ``min_points = 1`` every linked vector is a core
point and a cluster is a largest linked set.

Cells of the reduced space with the vectors that ask in them (:mod:`quern.llm.vector_cells`) are clustered on their own,
on the full vectors; local clusters that share a core point are merged, those of a task's cells in the task, those of
several tasks through the distributed components of the local clusters' graph. Within a cell links are folded into labels
block by block and never listed, so a dense cell costs no edge table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vector_cells import PRODUCTS, Cell, Cells, Scaling, Task, assign, fit_cells, left_out
from quern.operators.components import connected_components
from quern.operators.skew import skew_join
from quern.session import cut_lineage, opened, shared

BLOCK = 512


def _step(stored: int) -> int:
    """Asking rows that are compared at once with so many stored rows."""
    return int(np.clip(PRODUCTS // max(stored, 1), 16, BLOCK))


def partners(cell: Cell, threshold: float) -> np.ndarray:
    """Of each row that asks: how many stored vectors of other ids reach the threshold."""
    stored, asking = np.flatnonzero(cell.right & cell.home), np.flatnonzero(cell.left)
    across, many = cell.units[stored].T, np.zeros(len(asking), np.int64)
    step = _step(len(stored))
    for s in range(0, len(asking), step):
        rows = asking[s : s + step]
        near = cell.units[rows] @ across >= threshold
        many[s : s + step] = (near & (cell.ids[rows][:, None] != cell.ids[stored])).sum(axis=1)
    return many


def local_labels(cell: Cell, threshold: float, core: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Label of each row of the cell, equal for core points linked directly or through others, and (row, core row) of asking
    rows that are no core points. Links are sought between stored rows at home and all asking rows."""
    label = np.arange(len(cell.ids))
    left, right = np.flatnonzero(cell.right & cell.home & core), np.flatnonzero(cell.left)
    across, inner, border = cell.units[right].T, core[right], []
    step = _step(len(right))
    for s in range(0, len(left), step):
        rows = left[s : s + step]
        linked = cell.units[rows] @ across >= threshold
        if not inner.all():
            a, b = np.nonzero(linked[:, ~inner])
            border.append((right[~inner][b], rows[a]))
            linked = linked & inner
        at = label[right]
        low = np.minimum(np.where(linked, at, len(label)).min(axis=1, initial=len(label)), label[rows])
        high = np.maximum(np.where(linked, at, -1).max(axis=1, initial=-1), label[rows])
        for k in np.flatnonzero(low != high):
            these = np.append(label[right[linked[k]]], label[rows[k]])
            if these.min() != these.max():
                merge = np.arange(len(label))
                merge[these] = these.min()
                label = merge[label]
    return label, border


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after ``a`` and ``b`` became one, place by place; sets that are joined take the smallest of their labels."""
    while True:
        one, other = label[a], label[b]
        if (one == other).all():
            return label
        low, to = np.minimum(one, other), np.arange(len(label))
        np.minimum.at(to, one, low)
        np.minimum.at(to, other, low)
        while (to != to[to]).any():
            to = to[to]
        label = to[label]


def _local(batches: Iterator[pa.RecordBatch], cells: Cells, threshold: float) -> Iterator[pa.RecordBatch]:
    """``(id, root, core)``: core points with the smallest core id of their local cluster, and with ``core`` false the
    others with that of each cluster they touch. ``is_core`` of the rows tells core points; without it all linked are."""
    task = Task.of(batches, cells)
    if task is None:
        return
    names, node = np.unique(task.ids, return_inverse=True)
    label, linked, border = np.arange(len(names)), np.zeros(len(names), bool), [np.zeros((0, 2), np.int64)]
    for j in range(len(task.own)):
        cell = task.cell(j)
        core = np.ones(len(cell.ids), bool) if task.core is None else task.core[cell.at]
        local, touched = local_labels(cell, threshold, core)
        many = np.bincount(local, minlength=len(local))
        found = (many[local] > 1) if task.core is None else core
        at = node[cell.at]
        linked[at[found]] = True
        label = _merged(label, at[found], at[local[found]])
        for a, b in touched:
            border.append(np.unique(np.stack([at[a], at[local[b]]], axis=1), axis=0))
    inner, outer = np.flatnonzero(linked), np.concatenate(border)
    outer = np.unique(np.stack([outer[:, 0], label[outer[:, 1]]], axis=1), axis=0)
    for a, b, core in ((inner, label[inner], True), (outer[:, 0], outer[:, 1], False)):
        yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b]), pa.array(np.full(len(a), core))], names=["id", "root", "core"])


def _with_density(rows: DataFrame, held, threshold: float, min_points: int) -> DataFrame:
    """``rows`` plus ``is_core``. Every vector meets each partner in one task, so the tasks' numbers add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task.of(batches, opened(held))
        if task is not None:
            many = np.zeros(len(task.ids), np.int64)
            for j in range(len(task.own)):
                cell = task.cell(j)
                many[cell.at[cell.left]] += partners(cell, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(task.ids), pa.array(many)], names=["id", "n"])

    counts = rows.groupBy("grp", "block_l", "block_r").applyInArrow(count, "id bigint, n bigint")
    core = counts.groupBy("id").agg(F.sum("n").alias("n")).select("id", (F.col("n") >= min_points).alias("is_core"))
    return rows.join(cut_lineage(core), "id", "left").na.fill({"is_core": False})


def vector_clusters(
    vectors: DataFrame,
    row_id: str,
    vector: str,
    scaling: Scaling,
    threshold: float = 0.75,
    min_size: int = 3,
    min_points: int = 1,
) -> DataFrame:
    """``(cluster_id, id, size)`` of every id in a cluster of at least ``min_size`` ids; ``cluster_id`` is the smallest
    core id of the cluster.

    Rows with a null id or an unreadable vector (null, another number of elements, null, NaN or infinite elements, no
    direction) are left out; repeated rows count once, and an id with several different vectors is linked by any of
    them and counts once for each of them in ``min_points``. A vector that is near core points of several clusters
    belongs to the one of the smallest id. Empty input gives no row.

    Two vectors that reach the threshold meet in the cells of both.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(row_id).isNotNull())
    cells = fit_cells(rows, row_id, vector, scaling, threshold, keep=min_points + 1)
    if cells is None:
        return spark.createDataFrame([], "cluster_id bigint, id bigint, size bigint")
    spread = assign(rows, row_id, vector, cells)
    cells.sample = cells.sample[:0]
    held = shared(spark, cells)
    if min_points > 1:
        spread = _with_density(cut_lineage(spread), held, threshold, min_points).select(*spread.columns, "is_core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _local(batches, opened(held), threshold)

    local = spread.groupBy("grp", "block_l", "block_r").applyInArrow(run, "id bigint, root bigint, core boolean")
    local = cut_lineage(local.groupBy("id", "core").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
    member = local.where("core")
    links = member.where(F.size("roots") > 1).select(F.col("root").alias("a"), F.explode("roots").alias("b"))
    merged = connected_components(links).withColumnRenamed("node", "root")
    touched = local.where("not core").select("id", F.explode("roots").alias("root"))
    ends = member.select("id", "root").unionByName(touched).join(merged, "root", "left")
    found = ends.groupBy("id").agg(F.min(F.coalesce("component", "root")).alias("cluster_id")).select("cluster_id", "id")
    copies = left_out(rows, row_id, vector, cells)
    if copies is not None:
        found = cut_lineage(found)
        of_rep = found.join(F.broadcast(copies.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
        more = copies.join(F.broadcast(of_rep.withColumnRenamed("id", "rep")), "rep").select("cluster_id", "id")
        found = found.unionByName(more).groupBy("id").agg(F.min("cluster_id").alias("cluster_id")).select("cluster_id", "id")
    found = cut_lineage(found)
    sizes = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return skew_join(found, sizes, "cluster_id").select("cluster_id", "id", "size")


def _partial_sums(scaling: Scaling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of unit vectors per cluster of a partition; flushed where many clusters gather."""
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            sums = [held[k].tolist() for k in held]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["cluster_id", "part"])

        for batch in batches:
            rows, units = scaling.units(batch.column("v"))
            cluster = batch.column("cluster_id").to_numpy()[rows]
            order = np.argsort(cluster, kind="stable")
            names, begin = np.unique(cluster[order], return_index=True)
            if len(names):
                for k, total in zip(names.tolist(), np.add.reduceat(units[order].astype(np.float64), begin, axis=0), strict=True):
                    held[k] = held[k] + total if k in held else total
            if len(held) > 4_096:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def cluster_medoids(
    vectors: DataFrame, row_id: str, vector: str, scaling: Scaling, clusters: DataFrame, representatives: int = 3
) -> DataFrame:
    """``(cluster_id, size, rank, id, mean_similarity)``: the ``representatives`` most typical members of each cluster of
    ``clusters`` (``cluster_id, id, size``), by their mean cosine to all members.

    The sum of the cosines of a vector to all members is its product with the sum of the members' unit vectors, so the
    medoid is found exactly without comparing pairs. Of repeated ids the smallest vector counts; ties go by the id.
    """
    named = clusters.select(F.col("id").alias("i"), "cluster_id", "size")
    once = vectors.where(F.col(row_id).isNotNull() & (F.size(vector) == scaling.width)).select(
        F.col(row_id).cast("bigint").alias("i"), F.col(vector).cast("array<float>").alias("v")
    )
    rows = cut_lineage(once.join(named, "i").groupBy("i", "cluster_id", "size").agg(F.min("v").alias("v")))
    parts = rows.select("cluster_id", "v").mapInArrow(_partial_sums(scaling), "cluster_id bigint, part array<double>")
    # One row per cluster and task reaches the sums, which are added up in two steps.
    parts = parts.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = parts.groupBy("cluster_id", "some").applyInArrow(_add_up, "cluster_id bigint, part array<double>")
    sums = first.groupBy("cluster_id").applyInArrow(_add_up, "cluster_id bigint, part array<double>").withColumnRenamed("part", "total")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = scaling.units(batch.column("v"))
            whole = batch.column("total").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            mean = (units * whole).sum(axis=1) / batch.column("size").take(pa.array(at)).to_numpy()
            taken = [batch.column(c).take(pa.array(at)) for c in ("cluster_id", "size", "i")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(mean)], names=["cluster_id", "size", "id", "mean_similarity"])

    scored = skew_join(rows, sums, "cluster_id").mapInArrow(score, "cluster_id bigint, size bigint, id bigint, mean_similarity double")
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("mean_similarity", 6)), "id")
    # Ranked within partitions of the members first by Spark's group limit, so a large cluster is not sorted whole.
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= representatives)


def _add_up(group: pa.Table) -> pa.Table:
    width = len(group.column("part")[0])
    whole = group.column("part").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).sum(axis=0)
    return pa.table({"cluster_id": group.column("cluster_id").slice(0, 1), "part": pa.array([whole.tolist()], pa.list_(pa.float64()))})
