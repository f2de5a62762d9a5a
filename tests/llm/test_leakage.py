import random
import re

import pytest

from quern.llm.leakage import leaked_items

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def passage(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def brute(docs, items, window=20):
    words = lambda t: re.findall(r"[^\W_]+", t.lower()) if t else []
    runs = lambda w: {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
    found = {i: runs(words(t)) for i, t in items if i is not None}
    return {(d, i) for d, t in docs for i, r in found.items() if runs(words(t)) & r}


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id bigint, text string, h string")
    e = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, d int")
    return {tuple(r) for r in leaked_items(d, e, **how).collect()}


@pytest.fixture(scope="module")
def tables():
    items = [(i, passage(60)) for i in range(12)] + [(50, None), (None, passage(30)), (51, "short"), (52, "")]
    cut = lambda i, a, n: " ".join(items[i][1].split()[a : a + n])
    docs = [(100 + i, passage(200)) for i in range(20)]
    docs += [
        (1, passage(50) + " " + cut(3, 10, 25) + " " + passage(9)),
        (2, cut(4, 0, 20).upper().replace(" ", " -- ")),
        (3, passage(5) + " " + cut(5, 7, 19) + " " + passage(5)),
        (4, cut(6, 0, 60) + " " + cut(7, 30, 30)),
        (5, None), (6, ""), (7, "one"), (None, cut(8, 0, 30)), (1, cut(9, 5, 20)),
        (8, passage(40_000) + " " + cut(10, 40, 20)),
    ]
    return docs, items


def test_equals_brute_force(spark, tables):
    docs, items = tables
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert {(1, 3), (2, 4), (4, 6), (4, 7), (8, 10), (1, 9), (None, 8)} <= got and (3, 5) not in got


def test_several_passes_give_the_same(spark, tables, monkeypatch):
    import quern.llm.leakage as module

    monkeypatch.setattr(module, "MAX_ITEM_WINDOWS", 120)
    assert run(spark, *tables) == brute(*tables)


def test_edited_passages_are_found(spark):
    items = [(i, passage(40)) for i in range(40)]
    docs = []
    for i, t in items:
        w = t.split()[5:35]
        at = RNG.randrange(3, 27)
        kind = i % 3
        w[at : at + (kind != 1)] = [] if kind == 0 else ["new"]
        docs.append((i, passage(30) + " " + " ".join(w) + " " + passage(30)))
    found = run(spark, docs, items, max_edits=1)
    assert all(d == i for d, i in found)
    assert len(found) >= 0.95 * len(items)


def test_far_passages_are_not_reported(spark):
    items = [(0, passage(20))]
    w = items[0][1].split()
    docs = [(1, " ".join(x if k % 4 else "other" for k, x in enumerate(w)) + " " + passage(30))]
    assert run(spark, docs, items, max_edits=2) == set()


def test_empty_tables(spark, tables):
    docs, items = tables
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    assert run(spark, docs, [(1, None)]) == set()


def test_passages_that_lack_a_word_at_a_documents_end_are_found(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, words(20)) for i in range(40)]
    docs = []
    for i, w in items:
        at = rng.randrange(3, 17)
        docs.append((i, " ".join(words(30) + w[:at] + w[at + 1 :])))
    found = run(spark, docs, [(i, " ".join(w)) for i, w in items], max_edits=1)
    assert all(d == i for d, i in found)
    assert len(found) >= 0.95 * len(items)
