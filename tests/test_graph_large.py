"""Spectra of graphs beyond the dense bound: so few jobs that the number of products isn't felt."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.plans.graph import cluster_coverage, eigengap_citations, spectral_citations

N = 2_100


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("graph"), np.random.default_rng(12)
    ring = np.stack([np.arange(N), (np.arange(N) + 1) % N], axis=1)
    ends = np.concatenate([ring, rng.integers(0, N, size=(6 * N, 2))])
    pq.write_table(pa.table({"src": ends[:, 0], "dst": ends[:, 1]}), os.path.join(path, "ca_hepph.parquet"))
    return str(path)


def _jobs(spark, query, folder):
    """The rows and the number of Spark jobs they took."""
    sc = spark.sparkContext
    sc.setJobGroup(query.__name__, query.__name__)
    try:
        rows = query(spark, folder).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return rows, len(sc.statusTracker().getJobIdsForGroup(query.__name__))


def test_coverage_of_a_large_graph(spark, folder):
    rows, jobs = _jobs(spark, cluster_coverage, folder)
    assert {tuple(r) for r in rows} == {("pic", N, N), ("spectral", N, N)}
    assert jobs < 250, jobs


def test_clusters_of_a_large_graph(spark, folder):
    rows, jobs = _jobs(spark, spectral_citations, folder)
    assert sorted(r["node"] for r in rows) == list(range(N))
    assert jobs < 100, jobs


def test_eigenvalues_of_a_large_graph(spark, folder):
    rows, jobs = _jobs(spark, eigengap_citations, folder)
    g = pq.read_table(os.path.join(folder, "ca_hepph.parquet")).to_pandas()
    dense = np.zeros((N, N))
    dense[g["src"], g["dst"]] = dense[g["dst"], g["src"]] = 1
    np.fill_diagonal(dense, 0)
    root = np.sqrt(dense.sum(axis=0))
    exact = np.linalg.eigvalsh(np.eye(N) - dense / root / root[:, None])
    assert [r["eigenvalue"] for r in rows] == pytest.approx(exact[: len(rows)], abs=2e-6)
    assert jobs < 50, jobs
