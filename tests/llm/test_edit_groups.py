import random
import re

import numpy as np
import pytest

from quern.llm.edit_groups import BITS, Forest, NearDuplicates, apart, fingerprints, radius_of

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(300)]


def text(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def brute(rows, k, threshold, least):
    once = {}
    for i, t in rows:
        if i is not None and t is not None:
            once[i] = min(t, once.get(i, t))
    sets = {}
    for i, t in once.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= max(k, least):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


@pytest.fixture(scope="module")
def rows():
    out = []
    for g in range(25):
        base = text(RNG.randrange(12, 80))
        out.append((f"g{g}", " ".join(base)))
        for c in range(RNG.randrange(1, 5)):
            w = list(base)
            for _ in range(RNG.randrange(0, 4)):
                at = RNG.randrange(len(w))
                w[at : at + RNG.randrange(2)] = text(RNG.randrange(2))
            out.append((f"g{g}_{c}", " ".join(w)))
    template = text(60)
    for c in range(40):
        w = list(template)
        w[RNG.randrange(60)] = f"only{c}"
        out.append((f"t{c:02}", " ".join(w)))
    out += [(f"copy{c:02}", " ".join(template).upper() + "!") for c in range(15)]
    out += [("n", None), (None, " ".join(template)), ("e", ""), ("s", "one two"), ("g1", "zzz " * 20), ("long", " ".join(text(30_000)))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "key string, body string, id string")


@pytest.mark.parametrize(("k", "threshold", "least"), [(3, 0.6, 10), (5, 0.8, 0)])
@pytest.mark.parametrize("shard_rows", [8_192, 5])
def test_equals_brute_force(spark, rows, k, threshold, least, shard_rows):
    found = NearDuplicates(frame(spark, rows), "key", "body", k, threshold, least, shard_rows=shard_rows)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, k, threshold, least)


def test_groups(spark, rows):
    found = {r["id"]: (r["group_id"], r["class_links"]) for r in NearDuplicates(frame(spark, rows), "key", "body", 3, 0.6, 10).groups().collect()}
    parent = {i: i for i in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows, 3, 0.6, 10):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: g for i, (g, _) in found.items()} == {i: root(i) for i in found}
    assert found["copy00"][1] == 40 and found["long"] == ("long", 0)


def test_empty(spark):
    empty = NearDuplicates(frame(spark, []), "key", "body")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0
    with pytest.raises(ValueError):
        NearDuplicates(frame(spark, []), "key", "body", threshold=0)


def test_trees_equal_scan():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 12, size=(400, 2)).astype(np.uint64)
    prints[50:80] = prints[0]
    shard = rng.integers(0, 5, 400)
    forest = Forest(prints, shard, np.arange(300))
    for radius in (0, 2, 5):
        count = [0, 0]
        found = [p for a, b in forest.within(prints, shard, np.arange(250, 400), radius, count) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(set(found))
        assert set(found) == {(i, j) for i in range(300) for j in range(250, 400) if shard[i] == shard[j] and apart(prints[i], prints[j]) <= radius}
        assert count[0] < count[1]


def test_trees_prune_what_is_far_from_near_copies():
    """A shard of groups of near copies: a query within the radius of a node leaves out what is far from it."""
    rng = np.random.default_rng(4)
    heads = rng.integers(0, 1 << 62, size=(4, BITS // 64), dtype=np.int64).astype(np.uint64)
    prints = np.repeat(heads, 50, axis=0)
    for row in prints:
        for bit in rng.choice(BITS, 8, replace=False).tolist():
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    shard, count = np.zeros(200, np.int64), [0, 0]
    found = sum(len(a) for a, _ in Forest(prints, shard, np.arange(200)).within(prints, shard, np.arange(200), 40, count))
    assert found == 4 * 50 * 50 and count[0] < 0.7 * count[1]


def test_fingerprints_tell_the_similarity():
    rng = np.random.default_rng(2)
    distances = []
    for _ in range(200):
        both = rng.integers(-(1 << 62), 1 << 62, 60)
        a, b = np.r_[both, rng.integers(-(1 << 62), 1 << 62, 20)], np.r_[both, rng.integers(-(1 << 62), 1 << 62, 20)]
        p = fingerprints(np.r_[a, b], np.array([80, 80]))
        distances.append(apart(p[0], p[1]))
    assert max(distances) <= radius_of(0.6)
    assert np.mean(distances) == pytest.approx(BITS * 0.2, rel=0.1)
