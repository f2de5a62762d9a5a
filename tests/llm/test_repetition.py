import re

import pytest

from quern.llm.repetition import RULES, apply_rules, quality_metrics, repeated_share


def brute(text, run=5, least=20):
    if text is None:
        return None, None
    w = re.findall(r"[^\W_]+", text.lower())
    if len(w) < max(least, run):
        return len(w), None
    runs = [tuple(w[i : i + run]) for i in range(len(w) - run + 1)]
    return len(w), 1 - len(set(runs)) / len(runs)


TEXTS = [
    None, "", "   ", "one two", " ".join(f"w{i}" for i in range(40)), "a b c d e " * 30, "Buy now! " * 9, "Ä_ö.ß " * 20,
    " ".join(f"w{i % 7}" for i in range(100)), " ".join(f"v{i}" for i in range(60_000)), "spam ham eggs. " * 20_000,
    "x" * 300_000,
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(TEXTS)], "id int, text string, _h string, n_words int")
    got = {r["id"]: (r["n_words"], r["dup_run_ratio"]) for r in repeated_share(df).collect()}
    assert repeated_share(df).columns == ["id", "text", "_h", "n_words", "dup_run_ratio"]
    for i, t in enumerate(TEXTS):
        n, share = brute(t)
        assert got[i][0] == n
        assert got[i][1] == (None if share is None else pytest.approx(share)), t[:30]


def test_threshold_is_included(spark):
    words = [f"w{i}" for i in range(24)]  # 20 runs, of which a repeated block makes six repeat
    text = " ".join(words[:14] + words[:10])
    n, share = brute(text)
    assert n == 24 and share == pytest.approx(0.3)
    df = repeated_share(spark.createDataFrame([(text,)], "text string"))
    rule = next(r for r in RULES if r.metric == "dup_run_ratio")
    assert df.where(rule.broken()).count() == 1


def test_one_projection_without_functions_of_ours(spark, capsys):
    df = apply_rules(quality_metrics(spark.createDataFrame([("a b",)], "text string").repartition(1)))
    df.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1


def test_metrics_and_rules(spark):
    good = ("The study of the rivers and lakes is a long one, with many parts that have to be read. " * 1
            + " ".join(f"Sentence {chr(97 + i)} of the report." for i in range(8)))
    bad = "\n".join(["- click here ..."] * 12)
    df = spark.createDataFrame([(0, good), (1, bad), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: r for r in apply_rules(quality_metrics(df)).collect()}
    assert rows[0]["broken"] == []
    assert {"bullet_line_ratio", "ellipsis_line_ratio", "dup_line_ratio", "symbol_ratio"} <= set(rows[1]["broken"])
    assert rows[1]["dup_line_ratio"] == pytest.approx(11 / 12)
    assert rows[2]["broken"] == [] and rows[2]["stop_words"] is None
    assert rows[3]["mean_word_chars"] is None and "n_words" in rows[3]["broken"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert apply_rules(quality_metrics(df)).count() == 0
