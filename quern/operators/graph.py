"""Graphs as edge tables: canonical edges, degrees, normalised Laplacian, spectral and power iteration clustering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import SparseVector
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.rows import with_row_numbers
from quern.session import cut_lineage

#: Nodes of the largest graph whose dense Laplacian is decomposed on the driver.
MAX_DENSE_NODES = 2_000
#: Eigenvalues that are looked at for the eigengap.
LEADING = 12
#: Bytes of the sparse matrix and of the vectors that one task may hold to find eigenvectors.
MAX_SPARSE_BYTES = 600_000_000
#: Vectors that the iteration holds, those it keeps at a restart, largest residual, most restarts.
BASIS, KEPT, RESIDUAL, RESTARTS = 64, 28, 1e-10, 2_000


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """``(src, dst, weight)`` with ``src <= dst``, each edge once; the weight is the sum of the given column, or 1. Edges
    with a null end are left out, loops stay."""
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    value = F.sum(F.col(weight).cast("double")) if weight else F.lit(1.0)
    return ends.groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).agg(value.alias("weight"))


def degrees(graph: DataFrame) -> DataFrame:
    """``(node, degree, weighted_degree)``; a loop counts once. Both ends are reduced on the map side, so a hub is no
    hot key."""
    ends = graph.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def normalized_laplacian(graph: DataFrame) -> DataFrame:
    """``(src, dst, value)`` with ``src <= dst`` of I - D^-1/2 A D^-1/2 of the graph without its loops: 1 on the
    diagonal of nodes with an edge, 0 of nodes that have only loops."""
    plain = graph.where("src <> dst")
    d = degrees(plain).select("node", "weighted_degree")
    a = d.select(F.col("node").alias("src"), F.col("weighted_degree").alias("ds"))
    b = d.select(F.col("node").alias("dst"), F.col("weighted_degree").alias("dd"))
    off = plain.join(a, "src").join(b, "dst").select("src", "dst", (-F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("value"))
    every = degrees(graph).select("node").join(d, "node", "left")
    diagonal = every.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.when(F.col("weighted_degree") > 0, 1.0).otherwise(0.0).alias("value"))
    return off.unionByName(diagonal)


def laplacian_spectrum(graph: DataFrame, max_nodes: int = MAX_DENSE_NODES) -> tuple[list, np.ndarray, np.ndarray]:
    """Sorted nodes, ascending eigenvalues and eigenvectors (columns) of the normalised Laplacian. Raises beyond
    ``max_nodes``: use :func:`leading_spectrum` or :func:`power_iteration_clusters` there."""
    nodes = degrees(graph).select("node").limit(max_nodes + 1).toPandas()["node"].sort_values().tolist()
    if len(nodes) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    at = {n: i for i, n in enumerate(nodes)}
    dense = np.zeros((len(nodes), len(nodes)))
    for r in normalized_laplacian(graph).collect():
        dense[at[r["src"]], at[r["dst"]]] = dense[at[r["dst"]], at[r["src"]]] = r["value"]
    values, vectors = np.linalg.eigh(dense)
    return nodes, values, vectors


def eigengap(values: np.ndarray) -> int:
    """Number of clusters: one more than the place of the first gap between eigenvalues that exceeds both its neighbours;
    the largest gap where there is none."""
    gaps = np.diff(values)
    peaks = np.flatnonzero((gaps[1:-1] > gaps[:-2]) & (gaps[1:-1] > gaps[2:])) + 1
    return int(peaks[0] if len(peaks) else np.argmax(gaps) if len(gaps) else 0) + 1


def lanczos(product: Callable[[np.ndarray], np.ndarray], known: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, descending, and eigenvectors (rows) of a symmetric matrix in the complement of its ``known``
    eigenvectors (rows), by restarted Lanczos iteration with full orthogonalisation. Copies of one eigenvalue are found
    where the iteration ends early or by rounding only, as in ARPACK."""
    rng, n = np.random.default_rng(seed), known.shape[1]
    size = min(max(BASIS, 4 * k), n - len(known))
    kept = min(max(KEPT, 2 * k), size - 1)
    basis, small = np.zeros((size + 1, n)), np.zeros((size, size))

    def fresh(q: int) -> np.ndarray:
        v = rng.normal(size=n)
        for _ in range(2):
            v /= np.linalg.norm(v)
            v -= (known @ v) @ known
            v -= (basis[:q] @ v) @ basis[:q]
        return v / np.linalg.norm(v)

    basis[0], start = fresh(0), 0
    for _ in range(RESTARTS):
        for q in range(start, size):
            v, own = product(basis[q]), np.zeros(q + 1)
            for _ in range(2):
                v -= (known @ v) @ known
                part = basis[: q + 1] @ v
                v -= part @ basis[: q + 1]
                own += part
            small[: q + 1, q] = small[q, : q + 1] = own
            beta = float(np.linalg.norm(v))
            ended = beta < 1e-12
            beta = 0.0 if ended else beta
            if not ended:
                basis[q + 1] = v / beta
            elif q + 1 < n - len(known):
                basis[q + 1] = fresh(q + 1)
        values, turn = np.linalg.eigh(small)
        values, turn = values[::-1], turn[:, ::-1]
        if np.abs(beta * turn[-1, :k]).max(initial=0) < RESIDUAL or size == n - len(known):
            return values[:k], turn[:, :k].T @ basis[:size]
        basis[:kept] = turn[:, :kept].T @ basis[:size]
        basis[kept] = basis[size]
        small[:] = 0
        small[range(kept), range(kept)] = values[:kept]
        start = kept
    raise RuntimeError(f"not settled after {RESTARTS} restarts")


def sparse_spectrum(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest eigenvalues of the normalised Laplacian of nodes 0 .. n - 1, ascending, and eigenvectors (rows). Each
    connected component is a matrix of its own with one eigenvalue 0, so equal components don't hide each other's."""
    plain = a != b
    a, b, weight = a[plain], b[plain], weight[plain]
    part = np.arange(n)
    while True:
        least, before = np.minimum(part[a], part[b]), part.copy()
        np.minimum.at(part, a, least)
        np.minimum.at(part, b, least)
        part = part[part]
        if (part == before).all():
            break
    roots, part = np.unique(part, return_inverse=True)
    weighted = np.bincount(a, weight, n) + np.bincount(b, weight, n)
    root = np.sqrt(np.where(weighted > 0, weighted, 1))
    values, vectors = [0.0] * min(k, len(roots)), np.zeros((min(k, len(roots)), n))
    for c in range(len(values)):
        vectors[c] = root * (part == c)
        vectors[c] /= np.linalg.norm(vectors[c])
    more = k - len(values)
    for c in range(len(roots)) if more else ():
        at = np.flatnonzero(part == c)
        few = min(more, len(at) - 1)
        if not few:
            continue
        own = part[a] == c
        place = np.zeros(n, np.int32)
        place[at] = np.arange(len(at))
        i, j = place[a[own]], place[b[own]]
        value = weight[own] / (root[a[own]] * root[b[own]])
        i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
        order = np.argsort(i, kind="stable")
        starts = np.searchsorted(i[order], np.arange(len(at)))
        j, value = j[order], value[order]
        del i, order
        found, rows = lanczos(lambda v, j=j, value=value, starts=starts: np.add.reduceat(value * v[j], starts), vectors[c : c + 1, at], few)
        whole = np.zeros((few, n))
        whole[:, at] = rows
        values, vectors = values + (1 - found).tolist(), np.concatenate([vectors, whole])
    order = np.argsort(values, kind="stable")[:k]
    return np.array(values)[order], vectors[order]


def leading_spectrum(graph: DataFrame, n_vectors: int = LEADING, max_nodes: int = MAX_DENSE_NODES, max_bytes: int = MAX_SPARSE_BYTES) -> tuple[np.ndarray, DataFrame]:
    """The ``n_vectors`` smallest eigenvalues of the normalised Laplacian, ascending, and ``(node, v array<double>)`` of their
    eigenvectors. Up to ``max_nodes`` nodes by the dense matrix; then by the sparse one in a task, while that and the
    iteration's vectors take at most ``max_bytes``; beyond that as leading singular vectors of 2I - L, whose rows stay
    distributed and are multiplied with one vector a job, which takes long. The driver then holds ``n_vectors`` numbers a
    node, and a hub's row is as long as its degree."""
    spark, every = graph.sparkSession, degrees(graph).select("node")
    if every.limit(max_nodes + 1).count() <= max_nodes:
        nodes, values, vectors = laplacian_spectrum(graph, max_nodes)
        rows = [(n, v.tolist()) for n, v in zip(nodes, vectors[:, :n_vectors], strict=True)]
        return values[:n_vectors], spark.createDataFrame(rows, "node bigint, v array<double>")
    n, edges = every.count(), graph.count()
    if 24 * edges + 8 * (BASIS + 1) * n <= max_bytes:
        return _spectrum_in_a_task(graph, n_vectors)
    numbers = cut_lineage(with_row_numbers(every, "node"))
    half = normalized_laplacian(graph)
    off = half.where("src <> dst").select("src", "dst", (-F.col("value")).alias("value"))
    whole = off.unionByName(off.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")).unionByName(
        half.where("src = dst").select("src", "dst", (2 - F.col("value")).alias("value"))
    )
    at = whole.join(numbers.select(F.col("node").alias("src"), F.col("idx").alias("i")), "src").join(
        numbers.select(F.col("node").alias("dst"), F.col("idx").alias("j")), "dst"
    )
    lines = cut_lineage(at.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("e")).select("i", "e.j", "e.value"))
    matrix = IndexedRowMatrix(lines.rdd.map(lambda r: IndexedRow(r[0], SparseVector(n, r[1], r[2]))).persist(StorageLevel.MEMORY_AND_DISK), n, n)
    found = matrix.computeSVD(min(n_vectors, n - 1), computeU=True)
    rows = found.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector.toArray()]))
    vectors = spark.createDataFrame(rows, "idx bigint, v array<double>").join(numbers, "idx").select("node", "v")
    return 2 - np.array(found.s), cut_lineage(vectors)


def _spectrum_in_a_task(graph: DataFrame, n_vectors: int) -> tuple[np.ndarray, DataFrame]:
    def run(group: pa.Table) -> pa.Table:
        m = len(group)
        nodes, at = np.unique(np.concatenate([group.column("src").to_numpy(), group.column("dst").to_numpy()]), return_inverse=True)
        at = at.astype(np.int32)
        values, vectors = sparse_spectrum(at[:m], at[m:], group.column("weight").to_numpy(), len(nodes), n_vectors)
        rows = np.ascontiguousarray(np.vstack([values, vectors.T])).ravel()
        offsets = np.arange(0, len(rows) + 1, len(values), dtype=np.int32)
        named = pa.array(nodes, group.schema.field("src").type)
        return pa.table({"node": pa.concat_arrays([pa.nulls(1, named.type), named]), "v": pa.ListArray.from_arrays(offsets, rows)})

    kind = graph.schema["src"].dataType.simpleString()
    found = graph.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(run, f"node {kind}, v array<double>")
    found = cut_lineage(found)
    return np.array(found.where("node is null").first()["v"]), found.where("node is not null")


def spectral_clusters(graph: DataFrame, k: int | None = None, seed: int = 1, n_vectors: int | None = None, max_nodes: int = MAX_DENSE_NODES) -> DataFrame:
    """``(node, cluster)`` by k-means on eigenvectors of the normalised Laplacian, from the second one on: ``n_vectors``
    columns, by default k - 1, as the first one is constant. ``k`` by the eigengap of the ``LEADING`` smallest eigenvalues
    unless given. The same on library spectral clustering of the Laplacian: its affinity step is left out."""
    values, vectors = leading_spectrum(graph, max(LEADING, (k or 0) + 1, (n_vectors or 0) + 1), max_nodes)
    k = max(2, k or eigengap(values))
    points = vectors.select("node", array_to_vector(F.slice("v", 2, n_vectors or k - 1)).alias("features"))
    model = KMeans(k=k, seed=seed).fit(points)
    return model.transform(points).select("node", F.col("prediction").alias("cluster"))


def power_iteration_clusters(graph: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """``(node, cluster)`` of every node, distributed; nodes without an edge to another node get 0."""
    plain = graph.where("src <> dst")
    pic = PowerIterationClustering(k=k, maxIter=iterations, srcCol="src", dstCol="dst", weightCol="weight")
    found = pic.assignClusters(plain).withColumnRenamed("id", "node")
    return degrees(graph).select("node").join(found, "node", "left").select("node", F.coalesce("cluster", F.lit(0)).alias("cluster"))
