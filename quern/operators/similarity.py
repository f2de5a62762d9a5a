"""Near-duplicate text search: shingles, min-hash signatures, banding, verification and quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.minhash import PRIME, band_keys, clean_tokens, coefficients, portable_hash, text_shingles
from quern.functions.text import let
from quern.operators.skew import skew_join


def shingle_sets(
    docs: DataFrame, row_id: str, text: str, k: int, stop_words: Sequence[str] = ()
) -> DataFrame:
    """``(id, hashes)``: the distinct hashes of the runs of ``k`` cleaned tokens. Documents with fewer than ``k``
    tokens, a null text or a null id are left out; of repeated ids the smallest text counts."""
    once = docs.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(row_id).alias("id"))
    runs = text_shingles(clean_tokens("t", stop_words), k)
    hashes = F.array_distinct(F.transform(runs, portable_hash))
    return once.agg(F.min(text).alias("t")).select("id", hashes.alias("hashes")).where(F.size("hashes") > 0)


def signatures(sets: DataFrame, permutations: int) -> DataFrame:
    """``(id, signature)``: the least hash of each member of the family over the set ``hashes``; empty and null sets are left
    out. A batch of sets is hashed at once, by far faster than an expression per element."""
    family = coefficients(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            begin = np.cumsum(sizes) - sizes
            least = np.stack([np.minimum.reduceat((values * a + b) % PRIME, begin) for a, b in family], axis=1)
            places = pa.array(np.arange(len(least) + 1) * len(family), pa.int32())
            found = pa.ListArray.from_arrays(places, pa.array(least.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "signature"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "hashes").where(F.size("hashes") > 0).mapInArrow(run, f"id {kind}, signature array<bigint>")


def bands(signed: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """``(id, band)``: one row per band with the band's whole key."""
    return signed.select("id", F.explode(let(F.col("signature"), lambda s: band_keys(s, n_bands, rows))).alias("band"))


def collapse(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(representatives, members)``: one ``(id, hashes)`` per distinct set, its least id, and ``(id, rep)`` of all.
    Copies of one text are thereby paired, hashed and verified once, however many there are."""
    keyed = sets.withColumn("key", F.md5(F.array_join(F.array_sort("hashes").cast("array<string>"), ",")))
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = skew_join(keyed.select("id", "key", "hashes"), reps, "key")
    return members.where("id = rep").select("id", "hashes"), members.select("id", "rep")


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """Distinct ``(id1, id2)``, ``id1 < id2``, that share a band. Meant for the representatives of :func:`collapse`:
    then a pair is one of different texts and none of these is lost."""
    left, right = banded.alias("l"), banded.alias("r")
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.id") < F.col("r.id"))
    return left.join(right, same).select(F.col("l.id").alias("id1"), F.col("r.id").alias("id2")).distinct()


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` plus ``similarity`` = size of the intersection over size of the union of the two sets."""
    one = sets.select(F.col("id").alias("id1"), F.col("hashes").alias("h1"))
    two = sets.select(F.col("id").alias("id2"), F.col("hashes").alias("h2"))
    both = F.size(F.array_intersect("h1", "h2"))
    share = let(both, lambda n: n.cast("double") / (F.size("h1") + F.size("h2") - n))
    return pairs.join(one, "id1").join(two, "id2").select("id1", "id2", share.alias("similarity"))


def exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``(id1, id2, similarity)`` of all pairs of at least ``threshold`` (above 0): the truth that
    :func:`candidate_pairs` approximates.

    Two sets of n hashes that reach the threshold share one of their ``n - ceil(threshold * n) + 1`` smallest hashes, so
    only these are joined, with sizes that can reach it, and the pairs are verified: no pair is lost, and far fewer are
    formed than by a join on all hashes.
    """
    n = F.size("hashes")
    first = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1
    h = sets.select("id", n.alias("n"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), first)).alias("h"))
    l, r = h.alias("l"), h.alias("r")
    able = F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * F.lit(threshold) - 1e-9
    met = l.join(r, (F.col("l.h") == F.col("r.h")) & (F.col("l.id") < F.col("r.id")) & able)
    pairs = met.select(F.col("l.id").alias("id1"), F.col("r.id").alias("id2")).distinct()
    return jaccard(pairs, sets).where(F.col("similarity") >= threshold)


def similar_to(verified: DataFrame, threshold: float) -> DataFrame:
    """``(id, other, similarity)`` in both directions of the verified pairs of at least ``threshold``."""
    kept = verified.where(F.col("similarity") >= threshold)
    return kept.select(F.col("id1").alias("id"), F.col("id2").alias("other"), "similarity").unionByName(
        kept.select(F.col("id2").alias("id"), F.col("id1").alias("other"), "similarity")
    )


def quality(candidates: DataFrame, exact: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """One row: candidates, pairs that reach the threshold, found and missed ones, and candidates below it."""
    judged = jaccard(candidates, sets).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("similarity") >= threshold).alias("n_found"),
        F.count_if(F.col("similarity") < threshold).alias("n_false_candidates"),
    )
    truth = exact.agg(F.count(F.lit(1)).alias("n_similar"))
    return judged.crossJoin(truth).withColumn("n_missed", F.col("n_similar") - F.col("n_found"))


def tune(spark: SparkSession, settings: list[tuple[int, int]], similar: float = 0.85, dissimilar: float = 0.6) -> DataFrame:
    """For each (bands, rows): the threshold ``(1/b)^(1/r)``, the chance to miss a pair of similarity ``similar`` and
    the chance that one of ``dissimilar`` becomes a candidate."""
    table = spark.createDataFrame(settings, "bands int, rows int")
    b, r = F.col("bands").cast("double"), F.col("rows").cast("double")
    return table.select(
        "bands",
        "rows",
        F.pow(1 / b, 1 / r).alias("threshold"),
        F.pow(1 - F.pow(F.lit(similar), r), b).alias("miss"),
        (1 - F.pow(1 - F.pow(F.lit(dissimilar), r), b)).alias("false_candidate"),
    )
