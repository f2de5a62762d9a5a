"""Near-duplicate records with small edits.

Texts are compared by their sets of ``shingle`` consecutive words (Jaccard similarity). Texts of the same words are one
class from the start and are worked on once.

* *Fingerprint.* 256 one-bit min-hashes of the set. Two sets of similarity s differ in each bit with probability
  ``(1 - s) / 2``, so the Hamming distance of two fingerprints tells the similarity; ``radius`` bits are allowed, five
  standard deviations beyond what the threshold makes expect.
* *Shards.* In one global order of all shingles, sets that reach the threshold share one of their first
  ``n - ceil(threshold * n) + 1`` shingles (prefix filter, no loss in any order). Each such shingle is a shard. The order
  puts rare shingles first, by a table of counts of fixed size (``BUCKETS``), so shards stay small; a shard that is large
  all the same is split into blocks that meet pairwise.
* *BK-trees.* Each shard is a tree whose children are keyed by their integer Hamming distance to the parent. A query
  of distance d to a node follows only the edges d - radius .. d + radius. All candidates come from the trees. They
  live in the tasks that hold the shard: they are not broadcast, because all trees together grow with the corpus.
* *Verification.* The pairs within the radius are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let, run_hashes, word_hashes, words
from quern.operators.components import connected_components
from quern.operators.skew import skew_join
from quern.session import cut_lineage

WORDS = 4
BITS = 64 * WORDS
#: Places of the table of shingle counts: 8 MB at any size of the corpus.
BUCKETS = 1 << 20
#: Rows of a shard beyond which it is split into blocks.
SHARD_ROWS = 8_192
#: Pairs of query and node that are held at once.
QUERIES = 1 << 20
SEED = 20_240_303


def radius_of(threshold: float, deviations: float = 5.0) -> int:
    """Hamming distance that two sets at the threshold exceed with a probability of about 3e-7."""
    p = (1 - threshold) / 2
    return min(BITS, math.ceil(BITS * p + deviations * math.sqrt(BITS * p * (1 - p))))


def fingerprints(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprint, ``WORDS`` uint64, of each of the non-empty sets that stand one after another in ``values``."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, BITS, dtype=np.int64).astype(np.uint64) * 2 + 1
    begin = (np.cumsum(lengths) - lengths).astype(np.int64)
    out = np.zeros((len(lengths), WORDS), np.uint64)
    unsigned = values.view(np.uint64)
    mixed = unsigned ^ (unsigned >> np.uint64(31))
    for bit, factor in enumerate(factors):
        least = np.minimum.reduceat(mixed * factor, begin)
        out[:, bit // 64] |= ((least >> np.uint64(9)) & np.uint64(1)) << np.uint64(bit % 64)
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """Burkhard-Keller trees of many shards at once, as arrays: every node but a root hangs at its parent by the edge of
    their distance, and no two children of a node have the same edge. All trees grow and are searched in step, a level
    at a time. Equal fingerprints of a shard are one node."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray, rows: np.ndarray):
        """Of the places ``rows`` of ``prints``; ``shard`` numbers their shards from 0."""
        order = np.lexsort((*prints[rows].T, shard[rows]))
        rows = rows[order]
        new = np.r_[True, (np.diff(shard[rows]) != 0) | (np.diff(prints[rows].view(np.int64), axis=0) != 0).any(axis=1)][: len(rows)]
        self.rows, self.begin = rows, np.flatnonzero(new)
        self.many = np.diff(np.r_[self.begin, len(rows)])
        self.prints, tree = prints[rows[self.begin]], shard[rows[self.begin]]
        nodes = np.random.default_rng(SEED).permutation(len(self.begin))
        trees, first = np.unique(tree[nodes], return_index=True)
        self.root = np.full(int(shard.max(initial=-1)) + 1, -1)
        self.root[trees] = nodes[first]
        self.size = np.bincount(tree, minlength=len(self.root))
        at, waiting = self.root[tree[nodes]], np.delete(nodes, first)
        at = np.delete(at, first)
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            key = at * (BITS + 1) + apart(self.prints[waiting], self.prints[at])
            edge, head, place = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(waiting[head])
            at = np.delete(waiting[head][place.ravel()], head)
            waiting = np.delete(waiting, head)
        keys, children = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def within(self, prints: np.ndarray, shard: np.ndarray, queries: np.ndarray, radius: int, count: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the forest, query) of all pairs of a shard at most ``radius`` apart: a query at distance d from a node goes
        on along its edges d - radius .. d + radius. ``QUERIES`` pairs at most are held at once, but those of one query.
        To ``count``, if given, are added the numbers of edges followed and of all edges of the queries' trees."""
        queries = queries[self.root[shard[queries]] >= 0]
        part = np.cumsum(self.size[shard[queries]]) // QUERIES
        for asking in np.split(queries, np.flatnonzero(np.diff(part)) + 1):
            node = self.root[shard[asking]]
            if count is not None:
                count[1] += int((self.size[shard[asking]] - 1).sum())
            while len(asking):
                distance = apart(prints[asking], self.prints[node])
                hit = np.flatnonzero(distance <= radius)
                times = self.many[node[hit]]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield self.rows[np.repeat(self.begin[node[hit]], times) + offset], np.repeat(asking[hit], times)
                low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(distance + radius, BITS), side="right")
                edges = high - low
                if count is not None:
                    count[0] += int(edges.sum())
                offset = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                node, asking = self.children[np.repeat(low, edges) + offset], np.repeat(asking, edges)


def _prefixes(threshold: float, counts: np.ndarray, shard_rows: int):
    """Rows ``(shard, block_a, block_b, side, id, print, n, rest)`` of each class; ``rest`` counts the shingles behind
    the shard's in the class's order."""
    usual = 2 * counts.mean()

    def run(batches: Iterator[pa.RecordBatch], counts=counts) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("shingles")
            n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = sets.flatten().to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            prints = fingerprints(values, n)
            doc = np.repeat(np.arange(len(n)), n)
            common = counts[values & (BUCKETS - 1)]
            order = np.lexsort((values, common, doc))
            rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = rank < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(int) + 1, n)
            keep = order[first]
            at, shard = doc[keep], values[keep]
            rest = n[at] - rank[first] - 1
            many = np.ceil(np.maximum(common[keep] - usual, 1) / shard_rows).astype(np.int64)
            own = ((prints[at, 0] ^ (prints[at, 1] >> np.uint64(17))) % many.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(keep)), many)
            other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[row]),
                    pa.array(np.minimum(own[row], other).astype(np.int32)),
                    pa.array(np.maximum(own[row], other).astype(np.int32)),
                    pa.array((own[row] > other).astype(np.int32)),
                    batch.column("id").take(pa.array(at[row])),
                    *(pa.array(prints[at[row], w].view(np.int64)) for w in range(WORDS)),
                    pa.array(n[at[row]].astype(np.int32)),
                    pa.array(rest[row].astype(np.int32)),
                ],
                names=["shard", "block_a", "block_b", "side", "id", *PRINTS, "n", "rest"],
            )

    return run


PRINTS = [f"print_{w}" for w in range(WORDS)]


def _shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, many at a time, of batches sorted by shard: a batch's last shard waits for the next batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*kept, batch])
        same = np.ones(table.num_rows, bool)
        for c in ("shard", "block_a", "block_b"):
            same &= table.column(c).to_numpy() == table.column(c)[-1].as_py()
        begin = int(np.argmax(same))
        if begin:
            yield table.slice(0, begin)
        kept = table.slice(begin).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _search(threshold: float, radius: int):
    """Pairs ``(a, b)`` of ids within the radius whose sizes, and what can follow the shard's shingle if it is the
    first they share, can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shard_runs(batches):
            keys = np.stack([table.column(c).to_numpy() for c in ("shard", "block_a", "block_b")])
            prints = np.stack([table.column(c).to_numpy().view(np.uint64) for c in PRINTS], axis=1)
            n, side, rest = (table.column(c).to_numpy() for c in ("n", "side", "rest"))
            shard = np.cumsum(np.r_[0, (np.diff(keys) != 0).any(axis=0)])
            ids = table.column("id").combine_chunks()
            one = keys[1] == keys[2]
            forest = Forest(prints, shard, np.flatnonzero(one | (side == 0)))
            for a, b in forest.within(prints, shard, np.flatnonzero(one | (side == 1)), radius):
                # Within one block every pair comes up from both ends.
                some = (a < b) | ~one[a]
                a, b = a[some], b[some]
                need = threshold / (1 + threshold) * (n[a].astype(float) + n[b]) - 1e-9
                able = (1 + np.minimum(rest[a], rest[b]) >= need) & (np.minimum(n[a], n[b]) >= need)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[able])), ids.take(pa.array(b[able]))], names=["a", "b"])

    return run


class NearDuplicates:
    """Classes of texts of the same words, and the links between classes whose sets of shingles are similar enough.

    Rows with a null id or text, or with fewer than ``min_words`` (at least ``shingle``) words, take no part. Several
    rows of one id count once, with the smallest text. Texts of any length are read whole; empty input gives no row.
    """

    def __init__(
        self,
        docs: DataFrame,
        row_id: str,
        text: str,
        shingle: int = 5,
        threshold: float = 0.8,
        min_words: int = 0,
        shard_rows: int = SHARD_ROWS,
    ):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        self.threshold = threshold
        once = docs.where(F.col(row_id).isNotNull() & F.col(text).isNotNull())
        once = once.groupBy(F.col(row_id).alias("id")).agg(F.min(text).alias("t"))
        read = once.select("id", let(words("t"), lambda w: F.struct(
            F.size(w).alias("n"), F.unhex(F.md5(F.concat_ws(" ", w))).alias("class"),
            F.array_distinct(run_hashes(word_hashes(w), shingle)).alias("shingles"),
        )).alias("w"))
        read = cut_lineage(
            read.where(F.col("w.n") >= max(min_words, shingle)).select("id", F.col("w.class").alias("class"), "w.shingles")
        )
        #: ``(id, class)``
        self.members = read.select("id", "class")
        #: ``(id, shingles)`` of the classes
        self.sets = cut_lineage(read.groupBy(F.col("class").alias("id")).agg(F.first("shingles").alias("shingles")))
        self.links = cut_lineage(self._links(shard_rows))

    def _counts(self) -> np.ndarray:
        """Occurrences of the shingles of each of the ``BUCKETS`` places."""
        place = F.col("s").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        rows = self.sets.select(F.explode("shingles").alias("s")).groupBy(place.alias("place")).agg(
            F.count(F.lit(1)).alias("n")
        ).toArrow()
        counts = np.zeros(BUCKETS, np.int64)
        counts[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
        return counts

    def _links(self, shard_rows: int) -> DataFrame:
        held = self.sets.sparkSession.sparkContext.broadcast(self._counts())
        threshold = self.threshold

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _prefixes(threshold, held.value, shard_rows)(batches)

        prints = ", ".join(f"{c} bigint" for c in PRINTS)
        rows = self.sets.mapInArrow(
            prefixes, f"shard bigint, block_a int, block_b int, side int, id binary, {prints}, n int, rest int"
        )
        keys = ["shard", "block_a", "block_b"]
        shards = rows.repartition(*keys).sortWithinPartitions(*keys)
        near = shards.mapInArrow(_search(threshold, radius_of(threshold)), "a binary, b binary")
        pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        exact = both.select("a", "b", let(F.size(F.array_intersect("sa", "sb")), lambda x: x.cast("double") / (
            F.size("sa") + F.size("sb") - x)).alias("similarity"))
        return exact.where(F.col("similarity") >= self.threshold)

    def pairs(self) -> DataFrame:
        """``(id_a, id_b)``, ``id_a < id_b``: every linked pair of ids, copies included."""
        m, n = self.members.alias("m"), self.members.alias("n")
        copies = m.join(n, (F.col("m.class") == F.col("n.class")) & (F.col("m.id") < F.col("n.id")))
        copies = copies.select(F.col("m.id").alias("x"), F.col("n.id").alias("y"))
        linked = self.links.join(m.select(F.col("class").alias("a"), F.col("id").alias("x")), "a")
        linked = linked.join(n.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
        return copies.unionByName(linked).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``(id, group_id, class_links)`` of every id that takes part: the group is the smallest id of all texts linked
        directly or through others; ``class_links`` counts the classes linked to the id's class."""
        ends = self.links.select(F.col("a").alias("class")).unionByName(self.links.select(F.col("b").alias("class")))
        degree = ends.groupBy("class").agg(F.count(F.lit(1)).alias("class_links"))
        merged = connected_components(self.links.select("a", "b")).withColumnRenamed("node", "class")
        known = merged.join(degree, "class", "full")
        found = skew_join(self.members, known, "class", "left")
        found = found.select("id", F.coalesce("component", "class").alias("c"), F.coalesce("class_links", F.lit(0)).alias("class_links"))
        lowest = found.groupBy("c").agg(F.min("id").alias("group_id"))
        return skew_join(cut_lineage(found), lowest, "c").select("id", "group_id", "class_links")
