"""Repetition and surface quality of single documents as one projection.

A table of rules (metric, least, most) is compiled into a single select over the documents: no user function, no
shuffle. The metrics are ratios of lengths, symbols, stop words, lines and repeated word runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let, run_hashes, word_hashes, words

STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "for",
    "o", "os", "as", "de", "da", "do", "em", "que", "um", "uma", "el", "la", "los", "las", "y", "en", "un", "una",
    "der", "die", "das", "und", "ein", "eine", "den", "von", "zu", "mit",
)


SYMBOLS = r"#|\.\.\.|…|[<>{}|\\^~]"


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule where ``metric`` is below ``least``, above ``most`` or not below ``under``; never
    where it is null."""

    metric: str
    least: float | None = None
    most: float | None = None
    under: float | None = None

    def broken(self) -> Column:
        m, out = F.col(self.metric), F.lit(False)
        if self.least is not None:
            out = out | (m < self.least)
        if self.most is not None:
            out = out | (m > self.most)
        if self.under is not None:
            out = out | (m >= self.under)
        return F.coalesce(out, F.lit(False))


#: Published heuristics for web text: length, mean word length, symbols, stop words, line ends, repeated content.
RULES = (
    Rule("n_words", 20, 100_000),
    Rule("mean_word_chars", 3, 12),
    Rule("symbol_ratio", most=0.1),
    Rule("alpha_word_ratio", 0.7),
    Rule("stop_words", 2),
    Rule("stop_word_ratio", 0.01),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("dup_line_ratio", most=0.3),
    Rule("dup_paragraph_ratio", most=0.3),
    Rule("dup_line_char_ratio", most=0.2),
    Rule("dup_run_ratio", under=0.3),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole)


def _dup(parts: Column) -> Column:
    return _ratio(F.size(parts) - F.size(F.array_distinct(parts)), F.size(parts))


def _chars(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))


def _run_stats(text: str, run: int, min_words: int) -> Column:
    """Struct of the number of words and the repeated share of runs."""

    def of(h: Column) -> Column:
        n = F.when(h.isNotNull(), F.size(h))
        share = F.when(n >= min_words, let(run_hashes(h, run), _dup))
        return F.struct(n.alias("n_words"), share.alias("dup_run_ratio"))

    return let(word_hashes(words(text)), of)


def repeated_share(docs: DataFrame, text: str = "text", run: int = 5, min_words: int = 20) -> DataFrame:
    """``docs`` plus ``n_words`` and ``dup_run_ratio``: 1 - distinct / all runs of ``run`` consecutive words, one run
    per starting word. Null text gives null in both; fewer than ``min_words`` words (or than ``run``) give a null
    ratio. Whole texts of any length are read; existing columns of the two names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "dup_run_ratio")]
    stats = _run_stats(text, run, min_words)
    return docs.select(*kept, stats["n_words"].alias("n_words"), stats["dup_run_ratio"].alias("dup_run_ratio"))


def quality_metrics(docs: DataFrame, text: str = "text", run: int = 5, min_words: int = 20) -> DataFrame:
    """``docs`` plus every metric of ``RULES``. Ratios over nothing (no word, no line) are null, and all are null for
    a null text; existing columns of these names are replaced."""
    t = F.col(text)

    def of_words(w: Column) -> Column:
        stops = F.when(w.isNotNull(), F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))))
        return F.struct(_ratio(_chars(w), F.size(w)).alias("mean_word_chars"), stops.alias("stop_words"), F.size(w).alias("n"))

    def with_share(x: Column) -> Column:
        share = _ratio(x["stop_words"], x["n"])
        return F.struct(x["mean_word_chars"].alias("mean_word_chars"), x["stop_words"].alias("stop_words"), share.alias("stop_word_ratio"))

    def of_tokens(w: Column) -> Column:
        return F.struct(
            _ratio(F.regexp_count(t, F.lit(SYMBOLS)), F.size(w)).alias("symbol_ratio"),
            _ratio(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))), F.size(w)).alias("alpha_word_ratio"),
        )

    def of_lines(x: Column) -> Column:
        def share(pattern: str) -> Column:
            return _ratio(F.size(F.filter(x, lambda line: line.rlike(pattern))), F.size(x))

        return F.struct(
            share(r"^\s*[-*•]").alias("bullet_line_ratio"),
            share(r"(\.\.\.|…)\s*$").alias("ellipsis_line_ratio"),
            _dup(x).alias("dup_line_ratio"),
            let(_chars(x), lambda n: _ratio(n - _chars(F.array_distinct(x)), n)).alias("dup_line_char_ratio"),
        )

    parts = [
        (_run_stats(text, run, min_words), ("n_words", "dup_run_ratio")),
        (let(let(words(text), of_words), with_share), ("mean_word_chars", "stop_words", "stop_word_ratio")),
        (let(F.array_remove(F.split(t, r"\s+"), ""), of_tokens), ("symbol_ratio", "alpha_word_ratio")),
        (
            let(F.filter(F.split(t, r"\R"), lambda x: F.trim(x) != ""), of_lines),
            ("bullet_line_ratio", "ellipsis_line_ratio", "dup_line_ratio", "dup_line_char_ratio"),
        ),
    ]
    paragraphs = let(F.filter(F.split(t, r"\R\s*\R"), lambda x: F.trim(x) != ""), _dup)
    metrics = {name: part[name] for part, names in parts for name in names} | {"dup_paragraph_ratio": paragraphs}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in metrics]
    return docs.select(*kept, *[c.alias(name) for name, c in metrics.items()])


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` plus ``broken``: the names of the rules' metrics that the row breaks, in the table's order."""
    names = F.array(*[F.when(r.broken(), F.lit(r.metric)) for r in rules])
    return measured.withColumn("broken", F.array_compact(names))
