import pytest
from pyspark.sql import functions as F

from quern.operators.graph import degrees, eigengap, laplacian_spectrum, leading_spectrum, normalized_laplacian, power_iteration_clusters, sparse_spectrum, spectral_clusters, undirected
from quern.operators.recsys import centered, item_candidates, item_similarity, mean_ratings, pivoted, predict

EDGES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3), (3, 2), (None, 1)]


@pytest.fixture(scope="module")
def graph(spark):
    return undirected(spark.createDataFrame(EDGES, "src bigint, dst bigint")).persist()


def test_degrees_and_laplacian(graph):
    assert {r["node"]: r["degree"] for r in degrees(graph).collect()} == {0: 2, 1: 2, 2: 3, 3: 3, 4: 2, 5: 2}
    values = {(r["src"], r["dst"]): r["value"] for r in normalized_laplacian(graph).collect()}
    assert values[(2, 3)] == pytest.approx(-1 / 3) and values[(0, 1)] == pytest.approx(-0.5) and values[(4, 4)] == 1.0


@pytest.mark.parametrize("how", ["power", "spectral"])
def test_two_triangles_are_separated(graph, how):
    found = power_iteration_clusters(graph, 2) if how == "power" else spectral_clusters(graph, 2)
    label = {r["node"]: r["cluster"] for r in found.collect()}
    assert len({label[i] for i in (0, 1, 2)}) == 1 and len({label[i] for i in (3, 4, 5)}) == 1 and label[0] != label[5]


def test_spectrum(graph):
    nodes, values, _ = laplacian_spectrum(graph)
    assert nodes == [0, 1, 2, 3, 4, 5] and abs(values[0]) < 1e-9
    assert eigengap(values) >= 1
    with pytest.raises(ValueError):
        laplacian_spectrum(graph, max_nodes=3)


def test_loops_and_isolated_nodes(spark):
    g = undirected(spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "src bigint, dst bigint"))
    assert g.count() == 2
    values = {(r["src"], r["dst"]): r["value"] for r in normalized_laplacian(g).collect()}
    assert values == {(2, 3): -1.0, (1, 1): 0.0, (2, 2): 1.0, (3, 3): 1.0}


RATINGS = [(1, 1, 5.0), (2, 1, 3.0), (1, 2, 4.0), (3, 2, 2.0), (2, 3, 1.0), (3, 3, 4.0), (1, 3, None)]


@pytest.fixture(scope="module")
def ratings(spark):
    return mean_ratings(spark.createDataFrame(RATINGS, "u bigint, i bigint, r double"), "u", "i", "r").persist()


def test_centering_keeps_observed_zeros(spark, ratings):
    got = {(r["item"], r["user"]): r["centered"] for r in centered(ratings).collect()}
    assert got == {(1, 1): 1.0, (1, 2): -1.0, (2, 1): 1.0, (2, 3): -1.0, (3, 2): -1.5, (3, 3): 1.5}
    one = mean_ratings(spark.createDataFrame([(1, 2, 4.0)], "u bigint, i bigint, r double"), "u", "i", "r")
    assert centered(one).first()["centered"] == 0.0


def test_similarity_and_prediction(ratings):
    sim = item_similarity(centered(ratings))
    assert {(r["item1"], r["item2"]): round(r["similarity"], 6) for r in sim.collect()} == {(1, 2): 0.5, (1, 3): 0.5, (2, 3): -0.5}
    got = {(r["user"], r["item"]): r["prediction"] for r in predict(ratings, sim).collect()}
    assert got[(3, 1)] == pytest.approx(3.0) and got[(2, 2)] == pytest.approx(3.0) and (1, 1) not in got


def test_pivot_fills_zero(ratings):
    rows = {r["item"]: (r["1"], r["2"], r["3"]) for r in pivoted(ratings, "item", "user", [1, 2, 3], "rating").collect()}
    assert rows[1] == (5.0, 3.0, 0.0)


def test_items_of_equal_users_are_candidates(spark):
    df = spark.createDataFrame([(u, i, 1.0) for i in (1, 2) for u in range(10)] + [(99, 3, 1.0)], "user bigint, item bigint, rating double")
    assert {tuple(r) for r in item_candidates(df, 5, 2).collect()} == {(1, 2)}


def test_distributed_spectrum_equals_the_dense_one(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 130, size=(500, 2))] + [(500, 500)]
    g = undirected(spark.createDataFrame(rows, "src bigint, dst bigint"))
    exact, _ = leading_spectrum(g, 6)
    found, vectors = leading_spectrum(g, 6, max_nodes=10)
    assert np.abs(found - exact).max() < 1e-6
    assert {r["node"] for r in vectors.collect()} == {x for r in rows for x in r}
    clusters = spectral_clusters(g, 3, max_nodes=10).collect()
    assert len(clusters) == len({r["node"] for r in clusters}) == vectors.count()


def test_the_largest_graphs_stay_distributed(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    g = undirected(spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, size=(300, 2))], "src bigint, dst bigint"))
    exact, _ = leading_spectrum(g, 6)
    found, vectors = leading_spectrum(g, 6, max_nodes=10, max_bytes=0)
    assert np.abs(found - exact).max() < 1e-6 and vectors.count() == degrees(g).count()


@pytest.mark.parametrize("copies", [1, 3, 9])
def test_sparse_spectrum_of_equal_parts(copies):
    import numpy as np

    rng = np.random.default_rng(11)
    one = rng.integers(0, 150, size=(600, 2))
    one = np.concatenate([one, np.stack([np.arange(149), np.arange(1, 150)], axis=1)])
    ends = np.concatenate([one + 150 * i for i in range(copies)] + [[[150 * copies] * 2]])
    n, weight = 150 * copies + 1, rng.integers(1, 4, size=len(one)).astype(float)
    weight = np.concatenate([np.tile(weight, copies), [1.0]])
    dense = np.zeros((n, n))
    for (a, b), w in zip(ends, weight, strict=True):
        if a != b:
            dense[a, b] += w
            dense[b, a] += w
    d = dense.sum(axis=0)
    root = np.sqrt(np.where(d > 0, d, 1))
    laplacian = np.diag((d > 0).astype(float)) - dense / root / root[:, None]
    values, vectors = sparse_spectrum(ends[:, 0], ends[:, 1], weight, n, 8)
    assert np.abs(values - np.linalg.eigvalsh(laplacian)[:8]).max() < 1e-9
    assert np.abs(vectors @ vectors.T - np.eye(8)).max() < 1e-8
    assert np.abs(vectors @ laplacian - values[:, None] * vectors).max() < 1e-8


def test_sparse_spectrum_of_a_star_and_of_few_nodes():
    import numpy as np

    star = np.zeros(200, int), np.arange(1, 201), np.ones(200)
    assert np.abs(sparse_spectrum(*star, 201, 6)[0] - [0, 1, 1, 1, 1, 1]).max() < 1e-9
    values, vectors = sparse_spectrum(np.array([0]), np.array([1]), np.ones(1), 2, 6)
    assert np.abs(values - [0, 2]).max() < 1e-9 and vectors.shape == (2, 2)


def test_only_candidates_are_compared(ratings):
    scored = centered(ratings)
    every = item_similarity(scored)
    one = every.limit(1).select(F.col("item1").alias("id1"), F.col("item2").alias("id2"))
    assert item_similarity(scored, one).count() == 1
    assert item_similarity(scored, one.limit(0)).count() == 0
