import numpy as np
import pytest

from quern.llm.vector_cells import Scaling, pack, unpack
from quern.llm.vector_clusters import cluster_medoids, vector_clusters
from quern.llm.vector_neighbors import fit_books, nearest_neighbors

WIDTH = 24
RNG = np.random.default_rng(5)


def make(groups, noise):
    x = [c + 0.25 * RNG.normal(size=(n, WIDTH)) / np.sqrt(WIDTH) * 2 for n in groups for c in [unit(RNG.normal(size=WIDTH))]]
    return np.concatenate([*x, RNG.normal(size=(noise, WIDTH))]) * 3


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    return make([300, 120, 60, 9, 5, 3, 2], 400)


def frame(spark, x, more=()):
    rows = [(i, v.tolist(), "u", i) for i, v in enumerate(x.astype(np.float32))] + [(*r, "u", 0) for r in more]
    return spark.createDataFrame(rows, "track bigint, v array<float>, units string, id bigint")


def odd_rows(x):
    bad = [(10_000, None), (10_001, [1.0] * (WIDTH - 1)), (10_002, [None] + [1.0] * (WIDTH - 1)), (10_003, [float("nan")] * WIDTH),
           (10_004, [float("inf")] + [1.0] * (WIDTH - 1)), (10_005, [0.0] * WIDTH), (None, x[0].tolist())]
    return bad + [(0, x[0].astype(np.float32).tolist())] * 3


def scaling():
    return Scaling(None, None, WIDTH)


def brute_clusters(x, t, least):
    s = unit(x.astype(np.float32).astype(float))
    near = s @ s.T >= t
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    many = np.bincount(label, minlength=len(x))
    return {(int(label[i]), i) for i in range(len(x)) if many[label[i]] >= least}


@pytest.mark.parametrize("split", [False, True])
def test_clusters_equal_brute_force(spark, data, monkeypatch, split):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 60)
    if split:
        monkeypatch.setattr(cells, "GROUP_ROWS", 75)
    got = vector_clusters(frame(spark, data, odd_rows(data)), "track", "v", scaling(), 0.75, 3).collect()
    found = {(r["cluster_id"], r["id"]) for r in got}
    assert len(found) == len(got)
    assert found == brute_clusters(data, 0.75, 3)


def test_medoids_are_exact(spark, data):
    df = frame(spark, data, odd_rows(data))
    clusters = vector_clusters(df, "track", "v", scaling(), 0.75, 3).persist()
    got = cluster_medoids(df, "track", "v", scaling(), clusters, 1).collect()
    members = {}
    for r in clusters.collect():
        members.setdefault(r["cluster_id"], []).append(r["id"])
    assert {r["cluster_id"] for r in got} == set(members)
    for r in got:
        u = unit(data[members[r["cluster_id"]]])
        mean = u @ u.sum(0) / len(u)
        assert r["size"] == len(u) and r["mean_similarity"] == pytest.approx(mean.max(), abs=1e-5)


@pytest.mark.parametrize("split", [False, True])
def test_neighbours_recall(spark, data, monkeypatch, split):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 60)
    if split:
        monkeypatch.setattr(cells, "GROUP_ROWS", 75)
    k = 5
    got = nearest_neighbors(frame(spark, data, odd_rows(data)), "track", "v", scaling(), k, 0.75).collect()
    s = unit(data.astype(np.float32).astype(float))
    s = s @ s.T
    np.fill_diagonal(s, -1)
    truth = {(i, int(j)) for i in range(len(data)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= 0.75}
    found = {(r["id"], r["other"]) for r in got}
    assert len(found) == len(got) and max(r["rank"] for r in got) <= k
    assert len(found & truth) >= 0.95 * len(truth)
    for r in got:
        assert r["similarity"] == pytest.approx(s[r["id"], r["other"]], abs=1e-4)


def test_ties_go_by_the_smaller_id(spark):
    x = np.tile(RNG.normal(size=WIDTH), (8, 1))
    got = nearest_neighbors(frame(spark, x), "track", "v", scaling(), 3, 0.5).collect()
    assert {r["other"] for r in got if r["id"] == 7} == {0, 1, 2}
    assert {r["other"] for r in got if r["id"] == 0} == {1, 2, 3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * WIDTH)], [(5, [1.0] * WIDTH)]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame([(*r, "u", 0) for r in rows], "track bigint, v array<float>, units string, id bigint")
    assert vector_clusters(df, "track", "v", scaling()).count() == 0
    assert nearest_neighbors(df, "track", "v", scaling()).count() == 0


def test_packed_vectors_keep_cosines():
    x = unit(RNG.normal(size=(200, WIDTH))).astype(np.float32)
    y = unpack(pack(x), WIDTH)
    # A step is 1/32767 of the largest element, which is about 0.5 at this width.
    assert np.abs(x @ x.T - y @ y.T).max() < 5e-5


def test_beam_search_is_no_worse_than_greedy(data):
    coder = fit_books(unit(data).astype(np.float32), books=4, codewords=16)
    x = unit(data).astype(np.float32)
    flat = coder.words.reshape(-1, WIDTH)

    def error(beam):
        codes, products, norms = coder.encode(x, beam)
        coded = flat[codes].sum(axis=1)
        assert np.allclose(np.linalg.norm(coded, axis=1), norms, atol=1e-3)
        assert np.allclose((coded * x).sum(axis=1), products, atol=1e-3)
        return np.linalg.norm(x - coded, axis=1)

    assert error(8).mean() <= error(1).mean() + 1e-6


def dense_group(members, noise, cosine, width=64):
    """One round group around a direction, its members' mean cosine as given, and rows without neighbours."""
    rng = np.random.default_rng(11)
    off = unit(rng.normal(size=(members, width)))
    x = np.sqrt(cosine) * unit(rng.normal(size=width)) + np.sqrt(1 - cosine) * off
    return np.concatenate([x, unit(rng.normal(size=(noise, width)))])


def test_neighbours_in_a_group_of_a_third_of_the_rows(spark, monkeypatch):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    x, k = dense_group(1_000, 2_000, 0.85), 5
    got = nearest_neighbors(frame(spark, x), "track", "v", Scaling(None, None, 64), k, 0.75).collect()
    s = unit(x.astype(np.float32).astype(float))
    s = s @ s.T
    np.fill_diagonal(s, -1)
    truth = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= 0.75}
    found = {(r["id"], r["other"]) for r in got}
    assert len(found & truth) >= 0.995 * len(truth)


def test_loosely_linked_members_of_a_group_of_a_third_of_the_rows(spark, monkeypatch):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    x = dense_group(1_000, 2_000, 0.70, 256)
    got = vector_clusters(frame(spark, x), "track", "v", Scaling(None, None, 256), 0.75, 3).collect()
    assert {(r["cluster_id"], r["id"]) for r in got} == brute_clusters(x, 0.75, 3)


def test_an_id_with_many_vectors_takes_one_place(spark, monkeypatch):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "MIN_CELLS", 1)
    rng = np.random.default_rng(3)
    q = unit(rng.normal(size=WIDTH))
    near = [(1, unit(q + 0.01 * unit(rng.normal(size=WIDTH)))) for _ in range(20)]
    near += [(1 + i, unit(q + 0.1 * i * unit(rng.normal(size=WIDTH)))) for i in range(1, 6)]
    rows = [(i, v.tolist()) for i, v in [(0, q), *near]]
    df = spark.createDataFrame(rows, "track bigint, v array<float>")
    got = nearest_neighbors(df, "track", "v", scaling(), 5, 0.5).where("id = 0").orderBy("rank").collect()
    assert [r["other"] for r in got] == [1, 2, 3, 4, 5]


def brute_density(x, t, least, min_points):
    s = unit(x.astype(np.float32).astype(float))
    near = s @ s.T >= t
    np.fill_diagonal(near, False)
    core = near.sum(1) >= min_points
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = min(label[i], label[near[i] & core].min(initial=len(x)))
        if (new == label).all():
            break
        label = new
    cluster = {}
    for i in range(len(x)):
        own = label[i] if core[i] else label[near[i] & core].min(initial=len(x))
        if own < len(x):
            cluster.setdefault(int(own), []).append(i)
    return {(c, i) for c, members in cluster.items() if len(members) >= least for i in members}


@pytest.mark.parametrize("min_points", [1, 4, 40])
def test_core_points_link_and_others_join_them(spark, monkeypatch, min_points):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 60)
    rng = np.random.default_rng(9)
    heads = unit(rng.normal(size=(5, WIDTH)))
    x = np.concatenate([h + s * rng.normal(size=(n, WIDTH)) / np.sqrt(WIDTH) for h, s, n in zip(heads, (0.5, 0.6, 0.7, 0.4, 0.8), (200, 90, 60, 5, 150), strict=True)])
    x = np.concatenate([x, heads[:1] + heads[1:2] + 0.1 * rng.normal(size=(3, WIDTH)), rng.normal(size=(100, WIDTH))])
    got = vector_clusters(frame(spark, x), "track", "v", scaling(), 0.75, 3, min_points).collect()
    found = {(r["cluster_id"], r["id"]) for r in got}
    assert len(found) == len(got) and found == brute_density(x, 0.75, 3, min_points)


@pytest.fixture(scope="module")
def copied():
    """A third of the rows are copies of one vector, near those of another group; ids are mixed."""
    rng = np.random.default_rng(12)
    one = rng.normal(size=WIDTH)
    x = np.concatenate([np.tile(one, (500, 1)), one + 0.3 * rng.normal(size=(40, WIDTH)), rng.normal(size=(900, WIDTH))])
    return x[rng.permutation(len(x))]


def test_copies_that_hold_a_third_of_the_rows(spark, copied, monkeypatch):
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 60)
    k, df = 5, frame(spark, copied)
    s = unit(copied.astype(np.float32).astype(float))
    s = np.round(s @ s.T, 6)
    np.fill_diagonal(s, -1)
    truth = {(i, int(j)) for i in range(len(s)) for j in np.lexsort((np.arange(len(s)), -s[i]))[:k] if s[i, j] >= 0.75}
    got = nearest_neighbors(df, "track", "v", scaling(), k, 0.75).collect()
    found = {(r["id"], r["other"]) for r in got}
    assert len(found) == len(got) and len(found ^ truth) <= 0.01 * len(truth)
    for points in (1, 3):
        clusters = {(r["cluster_id"], r["id"]) for r in vector_clusters(df, "track", "v", scaling(), 0.75, 3, points).collect()}
        assert clusters == brute_density(copied, 0.75, 3, points)


def test_only_candidates_are_scored_exactly():
    """Round groups and rows without neighbours: the table lookup spares most pairs, and hardly one is scored besides."""
    from quern.llm.vector_cells import Cell
    from quern.llm.vector_neighbors import search_cell

    rng = np.random.default_rng(13)
    x = np.concatenate([dense_group(150, 0, 0.85, 128) @ np.linalg.qr(rng.normal(size=(128, 128)))[0] for _ in range(6)])
    x = unit(np.concatenate([x, rng.normal(size=(600, 128))])[rng.permutation(1_500)]).astype(np.float32)
    every, ids = np.ones(len(x), bool), np.arange(len(x))
    coder = fit_books(x)
    count = [0, 0, 0]
    a, b, cos = search_cell(Cell(ids, ids, x, ids, every, every, every), coder, coder.tables(x), 5, 0.75, count)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    truth = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.75}
    assert len(truth & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.99 * len(truth)
    assert count[1] < 0.5 * count[0] and count[2] <= 1.5 * count[1]


def test_many_equal_vectors_need_little_memory():
    import tracemalloc

    from quern.llm.vector_cells import Cell
    from quern.llm.vector_neighbors import search_cell

    rng = np.random.default_rng(14)
    x = np.tile(unit(rng.normal(size=WIDTH)).astype(np.float32), (10_000, 1))
    every, ids = np.ones(len(x), bool), np.arange(len(x))
    coder = fit_books(unit(rng.normal(size=(500, WIDTH))).astype(np.float32))
    tables = coder.tables(x)
    tracemalloc.start()
    a, b, _ = search_cell(Cell(ids, ids, x, np.zeros(len(x), np.int64), every, every, every), coder, tables, 5, 0.5)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert len(a) == 50_000 and set(b[a == 9_999].tolist()) == {0, 1, 2, 3, 4} and set(b[a == 2].tolist()) == {0, 1, 3, 4, 5}


def test_no_task_holds_much_more_than_its_bound(spark, monkeypatch):
    """Also where a dense group holds a third of the rows and all its members ask for each other."""
    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    monkeypatch.setattr(cells, "GROUP_ROWS", 100)
    x = dense_group(1_000, 2_000, 0.85)
    df = frame(spark, x)
    fitted = cells.fit_cells(df, "track", "v", Scaling(None, None, 64), 0.75, 6)
    sizes = cells.assign(df, "track", "v", fitted).groupBy("grp", "block_l", "block_r", "role").count().collect()
    assert len({(r["grp"], r["block_l"], r["block_r"]) for r in sizes}) > 30
    assert max(r["count"] for r in sizes) <= 2 * 100


class Untouched:
    """A table that keeps the functions it is given."""

    def __init__(self):
        self.given = []

    def __getattr__(self, name):
        def call(*args):
            self.given += [a for a in args if callable(a) and not isinstance(a, type)]
            return self

        return call


def test_what_tasks_give_back_comes_in_bounded_batches(spark, monkeypatch):
    """Also where every vector asks in every group: 4 000 vectors and 200 groups are 800 000 sketches, and what is at home
    in one group asks in 200."""
    import tracemalloc

    import pyarrow as pa

    import quern.llm.vector_cells as cells

    monkeypatch.setattr(cells, "shared", lambda spark, value: value)
    monkeypatch.setattr(cells, "opened", lambda held: held)
    rng, width, groups = np.random.default_rng(15), 64, 200
    pivots = unit(rng.normal(size=(groups, width + 1))).astype(np.float32)
    pivots[:, -1] = 0
    x = np.concatenate([pivots[np.arange(2_000) % groups], np.tile(pivots[0], (2_000, 1))])[:, :width] + 0.01 * rng.normal(size=(4_000, width))
    blocks, one = np.ones((groups, 3), int), np.ones(groups, np.int64)
    c = cells.Cells(Scaling(None, None, width), np.eye(width, dtype=np.float32), np.eye(width, dtype=np.float32), np.pi, -2.0,
                    np.zeros((0, width), np.float32), pivots, np.arange(groups), one, np.full(groups, np.pi), blocks)
    frame = Untouched()
    cells.assign(frame, "id", "v", c)
    send, meet = frame.given[-2:]
    lists = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4_000)), lists], names=["id", "v"])
    tracemalloc.start()
    sent, first = 0, []
    for b in send(iter([batch])):
        assert len(b) <= 10_000
        sent += len(b)
        first.append(b.filter(pa.array(b.column("grp").to_numpy() == 0)))
    assert sent == 4_000 * (groups + 1)
    tracemalloc.reset_peak()
    many, at_home = 0, set()
    for b in meet(iter(first)):
        assert len(b) <= 10_000
        many += len(b)
        at_home |= set(b.column("id").to_numpy().tolist())
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert many == len(at_home) * groups and len(at_home) == 2_010


def test_coding_many_rows_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(16)
    x = unit(rng.normal(size=(20_000, 256))).astype(np.float32)
    coder = fit_books(x[:500])
    part = coder.encode(x[3_000:3_100])
    tracemalloc.start()
    codes, product, norm = coder.encode(x)
    deviation = coder.deviation(x, codes, product)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert (codes[3_000:3_100] == part[0]).all() and np.allclose(product[3_000:3_100], part[1], atol=1e-5)
    assert deviation.shape == norm.shape == (20_000,)
