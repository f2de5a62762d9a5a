import numpy as np
import pytest

from quern.functions.rows import differences, exact_sample, local_maxima, with_chunk, with_row_numbers
from quern.operators.bfr import Summary, bfr
from quern.operators.vectors import clean_vectors, cluster_metrics, diameters, merge_summaries, summaries, top_value_per_group
from quern.operators.ward import cut, elbow, ward_labels, ward_merges


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows], "id bigint, vector array<double>, c int")


def test_metrics_of_a_pair_and_a_single_point(spark):
    df = points(spark, [(1, (0, 0), 0), (2, (2, 0), 0), (3, (9, 9), 1)])
    got = {r["cluster"]: tuple(r)[1:] for r in cluster_metrics(df, "c").collect()}
    assert got == {0: (2, 1.0, 2.0, 2.0), 1: (1, 0.0, 0.0, 0.0)}


def test_diameter_over_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    df = points(spark, [(i, v, 0) for i, v in enumerate(x)])
    expected = max(np.linalg.norm(a - b) for a in x for b in x)
    assert diameters(df, "c", block=7).first()["diameter"] == pytest.approx(expected)


def test_summary_and_merge(spark):
    s = summaries(points(spark, [(1, (1, 2), 0), (2, (3, 4), 0)]), "c")
    r = s.first()
    assert (r["n"], r["sum"], [round(v, 9) for v in r["sumsq"]]) == (2, [4.0, 6.0], [10.0, 20.0])
    m = merge_summaries(s, s).first()
    assert m["n"] == 4 and m["sum"] == [8.0, 12.0]


def test_unreadable_vectors_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "i bigint, v array<double>")
    assert [r["id"] for r in clean_vectors(df, "i", "v", 2).collect()] == [1]


def test_mode_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (None, "q")], "g int, v string")
    assert {tuple(r) for r in top_value_per_group(df, "g", "v").collect()} == {(1, "a", 1), (2, "z", 2)}


def test_bfr_places_every_point_once(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, size=(120, 4)) for c in (0, 20, 40)] + [np.full((1, 4), 500.0)])
    result = bfr(points(spark, [(i, v, 0) for i, v in enumerate(x)]), 3, 6.0)
    rows = result.assignments.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(x)))
    kinds = {k: sum(r["kind"] == k for r in rows) for k in ("discard", "compressed", "retained")}
    assert result.discard.n.sum() == kinds["discard"] and result.compressed.n.sum() == kinds["compressed"]
    assert bfr(points(spark, []), 3, 6.0) is None


def test_variance_of_a_summary():
    s = Summary(np.array([2.0]), np.array([[4.0, 6.0]]), np.array([[10.0, 20.0]]))
    assert s.mean.tolist() == [[2.0, 3.0]] and s.deviation.tolist() == [[1.0, 1.0]]


def test_ward_separates_groups_and_every_cut_has_its_number(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, size=(10, 2)) for c in (0, 5, 10)])
    merges = ward_merges(x)
    assert [h for *_, h in merges] == sorted(h for *_, h in merges)
    assert cut(30, merges, 3).tolist() == [0] * 10 + [1] * 10 + [2] * 10
    labels = ward_labels(points(spark, [(i, v, 0) for i, v in enumerate(x)]), range(2, 5)).toPandas()
    assert labels.groupby("k")["cluster"].nunique().to_dict() == {2: 2, 3: 3, 4: 4}
    with pytest.raises(Exception, match="more than 5 rows"):
        ward_labels(points(spark, [(i, v, 0) for i, v in enumerate(x)]), range(2, 3), max_rows=5).collect()


def test_elbow(spark):
    df = spark.createDataFrame([(2, 10.0), (2, 6.0), (3, 4.0), (4, 4.0)], "k int, diameter double")
    assert [tuple(r) for r in elbow(df).orderBy("k").collect()] == [(2, 8.0, 0.5), (3, 4.0, 0.0), (4, 4.0, None)]


def test_row_helpers(spark):
    df = spark.range(100)
    assert sorted(r["idx"] for r in with_row_numbers(df, "id").collect()) == list(range(100))
    assert all(r["idx"] == r["id"] for r in with_row_numbers(df, "id").collect())
    assert exact_sample(df, "id", 7).collect() == exact_sample(df, "id", 7).collect()
    assert with_chunk(df, "id", 4).select("chunk").distinct().count() == 4
    v = spark.createDataFrame(list(enumerate([1.0, 3.0, 2.0, 5.0, 4.0])), "i int, v double")
    assert [r["i"] for r in local_maxima(v, "i", "v").collect()] == [1, 3]
    assert [r["diff"] for r in differences(v, "i", "v").orderBy("i").collect()] == [2.0, -1.0, 3.0, -1.0, None]


def test_distance_under_the_centers_covariance(spark):
    from quern.operators.vectors import mahalanobis_to_centers

    rng = np.random.default_rng(4)
    centers = [(i, c.tolist()) for i, c in enumerate(rng.normal(size=(4, 3)))]
    x = rng.normal(size=(20, 3))
    at = np.array([c for _, c in centers])
    inverse = np.linalg.pinv(np.cov(at, rowvar=False))
    got = {r["id"]: (r["center"], r["distance"]) for r in mahalanobis_to_centers(points(spark, [(i, v, 0) for i, v in enumerate(x)]), centers).collect()}
    for i, v in enumerate(x):
        d = [np.sqrt((v - c) @ inverse @ (v - c)) for c in at]
        assert got[i][0] == int(np.argmin(d)) and got[i][1] == pytest.approx(min(d))


def test_ward_clusters_the_whole_small_subset(spark):
    import os

    import duckdb

    from quern.plans.vectors import ward_metrics

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    n = duckdb.sql(rf"""
        select count(distinct try_cast(regexp_extract(track_id, '^\s*(\d+)(?:\.0)?\s*$', 1) as bigint)) from '{folder}/features.parquet'
        where len(feature) = 518 and len(list_filter(feature, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and try_cast(nullif(regexp_extract(track_id, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint)
            in (select track_id from '{folder}/tracks.parquet' where set_subset = 'small')""").fetchall()[0][0]
    sizes = ward_metrics(spark, folder).groupBy("k").sum("size").collect()
    assert {r["k"]: r["sum(size)"] for r in sizes} == dict.fromkeys(range(8, 17), n)
