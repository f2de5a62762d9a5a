import pytest

from quern.functions.minhash import clean_tokens, text_shingles
from quern.operators.components import connected_components
from quern.operators.similarity import bands, candidate_pairs, collapse, exact_pairs, jaccard, quality, shingle_sets, signatures, tune

TEXTS = [
    ("a", "one two three four five six seven eight nine ten"),
    ("b", "One, two three four five six seven eight nine ten!"),
    ("c", "one two three four five six seven eight nine eleven"),
    ("d", "nothing of this kind is here or there at all today"),
    ("e", "short"), ("f", None), (None, "one two three four five"), ("g", ""),
    ("a", "one two three four five six seven eight nine ten"),
]


@pytest.fixture(scope="module")
def sets(spark):
    return shingle_sets(spark.createDataFrame(TEXTS, "id string, text string"), "id", "text", 3).persist()


def test_tokens_and_shingles(spark):
    df = spark.createDataFrame([("a, b c d. e",), ("x x x x",), ("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(text_shingles(clean_tokens("t"), 3)).collect()]
    assert got == [["a b c", "b c d", "c d e"], ["x x x"], [], None]


def test_stop_words_are_dropped_and_case_kept(spark):
    df = spark.createDataFrame([("O Gato e a Lua",)], "t string")
    assert df.select(clean_tokens("t", ("o", "e", "a"))).first()[0] == ["Gato", "Lua"]


def test_jaccard_and_exact_pairs(spark):
    s = spark.createDataFrame([("a", [1, 2, 3]), ("b", [2, 3, 4])], "id string, hashes array<bigint>")
    pair = spark.createDataFrame([("a", "b")], "id1 string, id2 string")
    assert jaccard(pair, s).first()["similarity"] == 0.5
    assert exact_pairs(s, 0.5).first()["similarity"] == 0.5


def test_short_and_null_texts_are_left_out(sets):
    assert {r["id"] for r in sets.collect()} == {"a", "b", "c", "d"}


def test_copies_are_paired_once(sets):
    reps, members = collapse(sets)
    assert {(r["id"], r["rep"]) for r in members.collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")}
    assert reps.count() == 4


def test_candidates_are_pairs_and_found_ones_are_exact(sets):
    c = candidate_pairs(bands(signatures(sets, 60), 30, 2))
    exact = exact_pairs(sets, 0.6)
    # Eight shingles each; case is kept, so a and b share seven, a and c seven, b and c six.
    assert {(r["id1"], r["id2"]): round(r["similarity"], 6) for r in exact.collect()} == {
        ("a", "b"): round(7 / 9, 6), ("a", "c"): round(7 / 9, 6), ("b", "c"): 0.6,
    }
    row = quality(c, exact, sets, 0.6).first()
    assert row["n_missed"] == 0 and row["n_found"] + row["n_false_candidates"] == row["n_candidates"]


def test_tuning(spark):
    r = tune(spark, [(13, 11)]).first()
    assert (round(r["threshold"], 6), round(r["miss"], 6), round(r["false_candidate"], 6)) == (0.792013, 0.092482, 0.046151)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame(path + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (200, 151)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 151: 150, 200: 150}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_distinct_shingles_are_counted_without_collisions(spark, tmp_path):
    from quern.plans.similarity import K, STOP_WORDS, shingle_distinct_count

    # Runs of unlike words: enough of them that 28 bits of hash merge some.
    n, words = 60_000, 100
    rows = spark.range(n // words).selectExpr(
        "cast(id as string) as tweet_id", f"array_join(transform(sequence(1, {words}), i -> concat('x', id, 'y', i)), ' ') as text"
    )
    rows.write.parquet(str(tmp_path / "covid_news_full.parquet"))
    assert not {"x", "y"} & set(STOP_WORDS)
    assert shingle_distinct_count(spark, str(tmp_path)).collect()[0][0] == n // words * (words - K + 1)
