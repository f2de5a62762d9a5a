from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators.skew import heavy_keys, skew_aggregate, skew_distinct_counts, skew_join
from quern.plans.skew import p3_found

ROWS = [(7, i) for i in range(300)] + [(8, i % 5) for i in range(200)] + [(i, None) for i in range(100, 500)] + [(None, 1)] * 50


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k bigint, v bigint").persist()


def test_no_heavy_key_is_missed(rows):
    found = {r["k"] for r in heavy_keys(rows, "k", 0.1).collect()}
    assert {7, 8} <= found and len(found) <= 10


def test_counts_are_exact_for_heavy_and_other_keys(rows):
    got = skew_aggregate(rows, "k", {"n": F.count(F.lit(1)), "m": F.max("v")}, {"n": F.sum, "m": F.max}, 0.1)
    assert {r["k"]: r["n"] for r in got.collect()} == {k: n for k, n in Counter(k for k, _ in ROWS).items() if k is not None}
    assert {r["k"]: r["m"] for r in got.where("k in (7, 8, 100)").collect()} == {7: 299, 8: 4, 100: None}


def test_distinct_counts(rows):
    got = {r["k"]: r["n_distinct"] for r in skew_distinct_counts(rows, "k", "v").collect()}
    assert got[7] == 300 and got[8] == 5 and got[100] == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [0, 1_000])
def test_join_equals_plain_join(spark, rows, how, limit):
    right = spark.createDataFrame([(7, "a"), (7, "b"), (100, "c"), (999, "d"), (None, "e")], "k bigint, w string")
    got = skew_join(rows, right, "k", how, min_share=0.1, broadcast_bytes=limit)
    expected = rows.join(right, "k", how)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select("k", "v", "w").collect())) == sorted(map(key, expected.select("k", "v", "w").collect()))


def test_clashing_columns_raise(rows):
    with pytest.raises(ValueError):
        skew_join(rows, rows, "k")


def test_empty_and_null_only(spark):
    for data in ([], [(None, 1)]):
        df = spark.createDataFrame(data, "k bigint, v bigint")
        assert heavy_keys(df, "k", 0.1).count() == 0
        assert skew_aggregate(df, "k", {"n": F.count(F.lit(1))}, {"n": F.sum}).count() == 0
        assert skew_distinct_counts(df, "k", "v").count() == 0
        assert skew_join(df, df.select("k", F.lit(1).alias("w")), "k").count() == 0


def test_found_keys_of_small_tables(spark, tmp_path):
    codes = [(" 0012.0 ",)] * 3 + [("12",)] * 3 + [("x",)] * 50 + [(None,)] * 9 + [(str(i),) for i in range(100, 250)]
    spark.createDataFrame(codes, "code string").write.parquet(f"{tmp_path}/conditions.parquet")
    spark.createDataFrame([(1, 2)] * 2 + [(None, 1)] * 7, "src bigint, dst bigint").write.parquet(f"{tmp_path}/ca_hepph.parquet")
    assert {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()} == {("conditions", 12), ("ca_hepph", 1)}


def test_join_on_binary_keys(spark):
    left = spark.range(4_000).selectExpr("unhex(md5(cast(if(id % 3 = 0, 0, id % 500) as string))) as c", "id as v")
    right = spark.range(500).selectExpr("unhex(md5(cast(id as string))) as c", "id as w")
    got = skew_join(left, right, "c", min_share=0.02)
    assert got.count() == 4_000 and got.where("w <> if(v % 3 = 0, 0, v % 500)").count() == 0


def test_sketch_names_the_same_keys_at_every_use(spark):
    many = spark.range(0, 20_000, 1, 16).selectExpr("id % 997 as k")
    heavy = heavy_keys(many, "k", 0.01)
    assert sorted(heavy.collect()) == sorted(heavy.collect()) and heavy.count() <= 100
