"""Queries for repetition inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.repetition import RULES, STOP_WORDS, SYMBOLS, Rule, apply_rules, quality_metrics, repeated_share
from quern.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that break the table's rule on repeated runs of five words; what other rules need isn't computed."""
    rules = tuple(r for r in RULES if r.metric == "dup_run_ratio")
    judged = apply_rules(quality_metrics(_docs(spark, sf_dir)), rules)
    return judged.where(F.size("broken") > 0).select("doc_id")


def p8_repeated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repeated_share(_docs(spark, sf_dir))
    return measured.select("doc_id", "n_words", F.round("dup_run_ratio", 6).alias("dup_run_ratio"))


def p8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(quality_metrics(_docs(spark, sf_dir)))
    numbers = [F.round(r.metric, 6).alias(r.metric) for r in RULES if r.metric != "n_words"]
    return judged.select("doc_id", "n_words", *numbers, F.array_join("broken", ",").alias("broken"))


QUERIES = {"p8_found": p8_found, "p8_repeated_share": p8_repeated_share, "p8_quality_rules": p8_quality_rules}

_RUNS = r"""
    with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
    r as (select doc_id, len(w) as n_words,
                 case when len(w) >= 20 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end as r from w),
    s as (select doc_id, n_words, 1 - list_unique(r)::double / len(r) as share from r)"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BREAK = r"(?:\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])"
_LETTER = r"\p{L}"
_SPACE = r"[ \t\n\x0B\f\r]"


def _broken_sql(rule: Rule) -> str:
    tests = [(rule.least, "<"), (rule.most, ">"), (rule.under, ">=")]
    return "case when " + " or ".join(f"{rule.metric} {op} {v}" for v, op in tests if v is not None) + f" then '{rule.metric}' end"


def _dup_sql(parts: str) -> str:
    return f"case when len({parts}) > 0 then (len({parts}) - len(list_distinct({parts})))::double / len({parts}) end"


def _ratio_sql(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then ({part})::double / {whole} end"


def _hits_sql(parts: str, pattern: str) -> str:
    return f"len(list_filter({parts}, lambda x: regexp_matches(x, '{pattern}')))"


_QUALITY = f"""
    with p as (
        select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w,
               list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') as k,
               list_filter(regexp_split_to_array(text, '{_BREAK}'), lambda x: trim(x) <> '') as l,
               list_filter(regexp_split_to_array(text, '{_BREAK}{_SPACE}*{_BREAK}'), lambda x: trim(x) <> '') as g
        from documents),
    c as (select *, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) as lc,
                 coalesce(list_sum(list_transform(list_distinct(l), lambda x: length(x))), 0) as ld,
                 coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as wc,
                 case when len(w) >= 20 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end as r from p),
    m as (select doc_id, len(w) as n_words, {_ratio_sql("wc", "len(w)")} as mean_word_chars,
                 {_ratio_sql(f"len(regexp_extract_all(text, '{SYMBOLS}'))", "len(k)")} as symbol_ratio,
                 {_ratio_sql(_hits_sql("k", _LETTER), "len(k)")} as alpha_word_ratio,
                 len(list_filter(w, lambda x: x in ({_STOP}))) as stop_words,
                 {_ratio_sql(f"len(list_filter(w, lambda x: x in ({_STOP})))", "len(w)")} as stop_word_ratio,
                 {_ratio_sql(_hits_sql("l", f"^{_SPACE}*[-*•]"), "len(l)")} as bullet_line_ratio,
                 {_ratio_sql(_hits_sql("l", f"([.][.][.]|…){_SPACE}*$"), "len(l)")} as ellipsis_line_ratio,
                 {_dup_sql("l")} as dup_line_ratio, {_dup_sql("g")} as dup_paragraph_ratio,
                 {_ratio_sql("lc - ld", "lc")} as dup_line_char_ratio, {_dup_sql("r")} as dup_run_ratio from c)
    select doc_id, n_words, {", ".join(f"round({r.metric}, 6) as {r.metric}" for r in RULES if r.metric != "n_words")},
           array_to_string(list_filter([{", ".join(_broken_sql(r) for r in RULES)}], lambda x: x is not null), ',') as broken
    from m"""

ORACLE = {
    "p8_quality_rules": _QUALITY,
    "p8_found": f"{_RUNS} select doc_id from s where share >= 0.3",
    "p8_repeated_share": f"{_RUNS} select doc_id, n_words, round(share, 6) as dup_run_ratio from s",
}
