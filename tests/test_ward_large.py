"""Ward clusterings and metrics over rows of distances of more rows than a task can hold distances of."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.operators.vectors import nested_diameters
from quern.operators.ward import distance_row_metrics, ward_merges
from quern.plans.vectors import subset_row_metrics, ward_elbow, ward_invariants, ward_metrics

N, GROUPS = 10_100, 8


def _places() -> np.ndarray:
    rng = np.random.default_rng(8)
    group = np.arange(N) % GROUPS
    return (np.stack([group * 100, group % 2 * 50], axis=1) + rng.normal(size=(N, 2))).astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """``N`` tracks of the subset ``small`` in eight groups, in two of the 518 places."""
    path = tmp_path_factory.mktemp("ward")
    x = np.zeros((N, 518), np.float32)
    x[:, :2] = _places()
    vectors = pa.ListArray.from_arrays(np.arange(0, N * 518 + 1, 518, dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"track_id": [str(i) for i in range(N)], "feature": vectors}), os.path.join(path, "features.parquet"))
    pq.write_table(pa.table({"track_id": np.arange(N), "set_subset": ["small"] * N}), os.path.join(path, "tracks.parquet"))
    return str(path)


def _far(x: np.ndarray) -> float:
    return max(float(np.sqrt(((x - row) ** 2).sum(axis=1).max())) for row in x)


def _diameters() -> list[float]:
    x = _places().astype(float)
    return [_far(x[g::GROUPS]) for g in range(GROUPS)]


def test_merges_are_those_of_one_merge_at_a_time():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 3)), np.zeros((3, 3))])
    parts, heights = [[i] for i in range(len(x))], []
    while len(parts) > 1:
        cost = {
            (i, j): len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
            for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j
        }
        i, j = min(cost, key=cost.get)
        heights.append(cost[i, j])
        parts[i] += parts.pop(j)
    assert [h for *_, h in ward_merges(x)] == pytest.approx(heights, abs=1e-9)


def test_nested_diameters_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    cell = [i % 4 for i in range(60)]
    df = spark.createDataFrame([(i, [float(e) for e in v], c // 2, c) for i, (v, c) in enumerate(zip(x, cell, strict=True))], "id int, vector array<double>, whole int, cell int")
    members = spark.createDataFrame([(c, c) for c in range(4)] + [(10 + c // 2, c) for c in range(4)], "cluster int, cell int")
    got = {r["cluster"]: r["diameter"] for r in nested_diameters(df, "whole", "cell", members, block=7).collect()}
    at = np.array(cell)
    assert got == pytest.approx({c: _far(x[at == c]) for c in range(4)} | {10 + w: _far(x[at // 2 == w]) for w in range(2)})


def test_elbow_of_more_than_ten_thousand_rows(spark, folder):
    rows = {r["k"]: r["mean_diameter"] for r in ward_elbow(spark, folder).collect()}
    assert set(rows) == set(range(8, 17)) and rows[8] == pytest.approx(np.mean(_diameters()))


def test_metrics_of_more_than_ten_thousand_rows(spark, folder):
    rows = [r for r in ward_metrics(spark, folder).collect() if r["k"] == 8]
    assert sum(r["size"] for r in rows) == N
    assert sorted(r["diameter"] for r in rows) == pytest.approx(sorted(_diameters()))
    assert all(r["density"] == pytest.approx(r["size"] / r["radius"] ** 2) for r in rows)


def test_invariants_of_more_than_ten_thousand_rows(spark, folder):
    assert {tuple(r) for r in ward_invariants(spark, folder).collect()} == {(k, k, N) for k in range(8, 17)}


def test_row_metrics_of_more_than_ten_thousand_rows(spark, folder):
    x = _places().astype(float)
    high, gap = np.zeros(2), np.zeros(2)
    for s in range(0, N, 500):
        apart = np.sqrt(((x[:, None] - x[s : s + 500]) ** 2).sum(axis=2))
        for part in (0, 1):
            own = apart[part::2]
            high[part] = max(high[part], own.max())
            gap[part] = max(gap[part], np.abs(own - own.mean(axis=0)).max())
    got = {r["part"]: r for r in subset_row_metrics(spark, folder).collect()}
    for part in (0, 1):
        r = got[part]
        assert r["size"] == N // 2
        assert (r["radius"], r["diameter"], r["density"]) == pytest.approx((gap[part], high[part], N // 2 * N / high[part]), abs=2e-3)


def test_row_metrics_over_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3))
    x[7] = x[8]
    part = [None if i == 3 else i % 3 for i in range(40)]
    df = spark.createDataFrame([(i, [float(e) for e in v], p) for i, (v, p) in enumerate(zip(x, part, strict=True))], "id int, vector array<double>, part int")
    apart = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for block in (7, 1_000):
        for r in distance_row_metrics(df, "part", block=block).collect():
            own = apart[[p == r["cluster"] for p in part]]
            assert r["cluster"] is not None and r["size"] == len(own)
            assert (r["radius"], r["diameter"]) == pytest.approx((np.abs(own - own.mean(axis=0)).max(), own.max()))
            assert r["density"] == pytest.approx(len(own) * 40 / own.max())
