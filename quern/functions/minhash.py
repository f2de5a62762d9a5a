"""Shingles, min-hash signatures and bands as expressions that any SQL engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let

#: Modulus of the hash family: the Mersenne prime 2^31 - 1. With 28-bit shingle hashes, a * h + b stays below 2^60.
PRIME = 2_147_483_647
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPACE = r"[ \t\n\x0B\f\r]+"


def coefficients(permutations: int) -> list[tuple[int, int]]:
    """``(a, b)`` of each member of the hash family ``(a * h + b) mod PRIME``."""
    return [(1 + (i * 1_103_515_245 + 12_345) % (PRIME - 1), (i * 69_069 + 1) % PRIME) for i in range(permutations)]


def clean_tokens(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """White-space tokens of the text without ASCII punctuation; stop words are compared in lower case, tokens keep
    theirs. Null for null."""
    tokens = F.array_remove(F.split(F.regexp_replace(text, PUNCTUATION, ""), SPACE), "")
    stop = [w.lower() for w in stop_words]
    return F.filter(tokens, lambda w: ~F.lower(w).isin(stop)) if stop else tokens


def text_shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of ``k`` tokens joined by one blank; empty below ``k`` tokens, null for null."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return F.when(tokens.isNotNull(), let(tokens, of))


def portable_hash(s: Column) -> Column:
    """28-bit hash from the first seven hexadecimal digits of the MD5 digest."""
    return F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("bigint")


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """One key per band: the band's number and its ``rows`` values joined, as text."""

    def key(band: Column) -> Column:
        values = F.slice(signature, band * rows + 1, F.lit(rows)).cast("array<string>")
        return F.concat(band.cast("string"), F.lit("|"), F.array_join(values, "|"))

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)
