"""The most similar vectors of every vector by additive quantisation.

Vectors are coded as a sum of one full-dimensional codeword of each codebook. The codebooks are fitted on the bounded
sample one after another, each on what the former left over; a vector's code is found by beam search over all
codebooks. The cosine to a query is estimated by adding one table entry per codebook and dividing by a stored number,
the product of the vector with its code. How far the estimate may be off is stored too: the deviation of the product of
a random query with the part of the code that is perpendicular to the vector. The stored norm of the code gives a
certain lower bound of the cosine besides. A vector is a candidate of a query unless its estimate, ``DEVIATIONS`` above,
stays below the threshold or below what the k-th best reaches for certain; the query's own candidates are then scored
exactly.

The codes are searched cell by cell (:mod:`quern.llm.vector_cells`): a vector is stored in its home cell, and each
vector asks in every cell of its margin where the sketches show a possible partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vector_cells import PRODUCTS, Cell, Scaling, Task, assign, fit_cells, left_out
from quern.session import cut_lineage, opened, shared

BOOKS, CODEWORDS, BEAM = 6, 64, 4
#: Codebooks are fitted on this many rows of the sample.
BOOK_SAMPLE = 4_096
#: Deviations, and what rounding may add, by which an estimate may be off.
DEVIATIONS, SLACK = 4.0, 2e-3
#: Queries whose estimates are held at once, and of those the ones whose candidates are scored together.
BLOCK, TOGETHER = 256, 16
#: Asking rows of a task whose tables are held at once, and stored rows that are coded at once.
ASKING, CODED = 8_192, 1_024
SEED = 20_240_302


@dataclass
class Additive:
    """``words``: books x codewords x width. ``cross``: products of all pairs of codewords. ``root``: of the second moments of
    the sample's vectors, width x width."""

    words: np.ndarray
    cross: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, sample: np.ndarray) -> Additive:
        flat = words.reshape(-1, words.shape[-1])
        value, vector = np.linalg.eigh((sample.T @ sample / len(sample)).astype(np.float64))
        return cls(words, flat @ flat.T, (vector * np.sqrt(np.maximum(value, 0))).astype(np.float32))

    def deviation(self, x: np.ndarray, codes: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Standard deviation of what the estimates of each unit row are off for a random query: one of the sample's, or
        one in any direction, whichever is more. Infinite for a code that has no part along the row."""
        parts = [self._deviation(x[s : s + CODED], codes[s : s + CODED], product[s : s + CODED]) for s in range(0, max(len(x), 1), CODED)]
        return np.concatenate(parts)

    def _deviation(self, x: np.ndarray, codes: np.ndarray, product: np.ndarray) -> np.ndarray:
        coded = product > 1e-3
        flat = self.words.reshape(-1, self.words.shape[-1])
        off = flat[codes].sum(axis=1) / np.where(coded, product, 1)[:, None] - x
        least = np.linalg.norm(off, axis=1) / np.sqrt(x.shape[1])
        return np.where(coded, np.maximum(np.linalg.norm(off @ self.root, axis=1), least), np.inf).astype(np.float32)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each row with every codeword of every book."""
        return x @ self.words.reshape(-1, self.words.shape[-1]).T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit rows: codes, as places in the flat table of codewords, products of the vectors with their codes, and
        norms of the codes."""
        parts = [self._encode(x[s : s + CODED], beam) for s in range(0, max(len(x), 1), CODED)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        books, k, _ = self.words.shape
        n, dots = len(x), self.tables(x)
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)  # |x - coded|^2 - |x|^2
        for m in range(books):
            place = np.arange(m * k, m * k + k)
            gain = self.cross[place, place] - 2 * dots[:, place]
            new = cost[:, :, None] + gain[:, None, :]
            for j in range(m):
                new += 2 * self.cross[codes[:, :, j]][:, :, place]
            flat = new.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(flat, best, axis=1)
            former = np.take_along_axis(codes, (best // k)[:, :, None], axis=1)
            codes = np.concatenate([former, (best % k + m * k)[:, :, None]], axis=2)
        at = np.argmin(cost, axis=1)
        chosen = codes[np.arange(n), at]
        product = np.take_along_axis(dots, chosen, axis=1).sum(axis=1)
        square = np.take_along_axis(cost, at[:, None], axis=1)[:, 0] + 2 * product
        return chosen, product, np.sqrt(np.maximum(square, 1e-12))

    def candidates(self, lut: np.ndarray, stored: tuple[np.ndarray, ...], begin: np.ndarray, k: int, threshold: float) -> np.ndarray:
        """Whether each stored vector may be among the ``k`` best ids of at least ``threshold`` of each query. ``stored``:
        codes, products, norms and deviations; ``begin``: where the rows of each id begin."""
        codes, product, norm, deviation = stored
        score = np.take(lut, codes[:, 0], axis=1)
        for m in range(1, codes.shape[1]):
            score += np.take(lut, codes[:, m], axis=1)
        least = np.full(len(lut), threshold, np.float32)
        if len(begin) > k:
            # Certain bounds: the parts beside the code at worst point in opposite directions.
            along = score / norm
            low = along * (product / norm)
            low -= np.sqrt(np.maximum(1 - along * along, 0)) * np.sqrt(np.maximum(1 - (product / norm) ** 2, 0))
            low = low if len(begin) == len(norm) else np.maximum.reduceat(low, begin, axis=1)
            least = np.maximum(least, np.partition(low, len(begin) - k, axis=1)[:, len(begin) - k])
        score /= np.where(np.isfinite(deviation), product, 1)
        # Of a query at a cosine of at least c only the part beside the vector, sqrt(1 - c^2), can err.
        beside = np.sqrt(np.maximum(1 - np.clip(least, 0, 1) ** 2, 0))
        return score + (DEVIATIONS * deviation) * beside[:, None] + SLACK >= least[:, None]


def fit_books(sample: np.ndarray, books: int = BOOKS, codewords: int = CODEWORDS, rounds: int = 6) -> Additive:
    """Residual codebooks by k-means, one after another."""
    rng = np.random.default_rng(SEED)
    left = sample[:BOOK_SAMPLE].copy()
    words = []
    for _ in range(books):
        c = left[rng.choice(len(left), codewords, replace=len(left) < codewords)].copy()
        for _ in range(rounds):
            home = np.argmax(left @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            order = np.argsort(home, kind="stable")
            many = np.bincount(home, minlength=codewords)
            filled = np.flatnonzero(many)
            begin = np.searchsorted(home[order], filled)
            c[filled] = np.add.reduceat(left[order], begin, axis=0) / many[filled, None]
        left -= c[np.argmax(left @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)]
        words.append(c)
    return Additive.of(np.stack(words).astype(np.float32), sample)


def _few_copies(ids: np.ndarray, marks: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows, by id, of which at most ``most`` have the same vector: those of the smallest ids. As equal
    cosines go by the smaller id, further copies are never among the ``most - 1`` best others of any query."""
    order = np.lexsort((ids, marks))
    first = np.flatnonzero(np.r_[True, np.diff(marks[order]) != 0])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    kept = order[nth < most]
    return kept[np.argsort(ids[kept], kind="stable")]


def exact_scores(queries: np.ndarray, units: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """Cosines, -2 where not ``wanted``, and how many were computed. Queries whose candidates coincide are scored in one
    product, otherwise pair by pair."""
    out, done = np.full(wanted.shape, -2.0), 0
    for s in range(0, len(queries), TOGETHER):
        part = wanted[s : s + TOGETHER]
        columns = np.flatnonzero(part.any(axis=0))
        if part.sum() * 1.5 >= part.shape[0] * len(columns):
            found = np.full(part.shape, -2.0)
            found[:, columns] = queries[s : s + TOGETHER] @ units[columns].T
            out[s : s + TOGETHER] = np.where(part, found, -2)
            done += part.shape[0] * len(columns)
        else:
            for q in range(len(part)):
                own = np.flatnonzero(part[q])
                out[s + q, own] = units[own] @ queries[s + q]
                done += len(own)
    return np.round(out, 6), done


def search_cell(
    cell: Cell,
    coder: Additive,
    tables: np.ndarray,
    k: int,
    threshold: float,
    count: list[int] | None = None,
    coded: list[tuple[np.ndarray, ...]] | None = None,
) -> tuple[np.ndarray, ...]:
    """(query id, other id, cosine) of the ``k`` best others of each left row among the right rows at home. ``tables`` holds
    the products of the rows at ``cell.at`` with the codewords. To ``count``, if given, are added the numbers of pairs, of
    candidates and of exact scores. ``coded``, if given, keeps the codes of the cell for the next call."""
    stored, asking = np.flatnonzero(cell.right & cell.home), np.flatnonzero(cell.left)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(stored) or not len(asking):
        return out[0]
    stored = stored[_few_copies(cell.ids[stored], cell.marks[stored], k + 1)]
    units, ids = cell.units[stored], cell.ids[stored]
    begin = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    if coded:
        codes = coded[0]
    else:
        codes, product, norm = coder.encode(units)
        codes = (codes, product, norm, coder.deviation(units, codes, product))
        if coded is not None:
            coded.append(codes)
    # Queries of the same first word come together, as their candidates often coincide.
    asking = asking[np.argsort(np.argmax(tables[cell.at[asking], : coder.words.shape[1]], axis=1), kind="stable")]
    step = int(np.clip(PRODUCTS // len(stored), 16, BLOCK))
    for s in range(0, len(asking), step):
        rows = asking[s : s + step]
        mine = cell.ids[rows]
        # The query itself is among the stored.
        wanted = coder.candidates(tables[cell.at[rows]], codes, begin, k + 1, threshold)
        wanted &= mine[:, None] != ids
        exact, done = exact_scores(cell.units[rows], units, wanted)
        if count is not None:
            count[:] = [count[0] + wanted.size, count[1] + int(wanted.sum()), count[2] + done]
        best = exact if len(begin) == len(ids) else np.maximum.reduceat(exact, begin, axis=1)
        least = np.full(len(rows), threshold)
        if len(begin) > k:
            least = np.maximum(least, -np.partition(-best, k - 1, axis=1)[:, k - 1])
        a, b = np.nonzero(best >= least[:, None])
        # Ids ascend, so a stable sort keeps ties in their order.
        order = np.lexsort((-best[a, b], a))
        a, b = a[order], b[order]
        first = np.searchsorted(a, a)
        kept = np.arange(len(a)) - first < k
        a, b = a[kept], b[kept]
        out.append((mine[a], ids[begin[b]], best[a, b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_neighbors(
    vectors: DataFrame,
    row_id: str,
    vector: str,
    scaling: Scaling,
    k: int = 5,
    threshold: float = -1.0,
) -> DataFrame:
    """``(id, other, similarity, rank)``: up to ``k`` other ids of each id, of those with a cosine of at least
    ``threshold``, the most similar first; equal cosines (to six digits) go by the smaller ``other``.

    Rows with a null id or an unreadable vector are left out; repeated rows count once, and of an id with several
    different vectors the best cosine counts. Empty input gives no row. The index holds every row and no cell that can
    hold a neighbour is left out: in a dense group all its members meet, and a ``threshold`` of -1 compares all rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(row_id).isNotNull())
    cells = fit_cells(rows, row_id, vector, scaling, threshold, keep=k + 1)
    if cells is None:
        return spark.createDataFrame([], "id bigint, other bigint, similarity double, rank int")
    coder = fit_books(cells.sample)
    spread = assign(rows, row_id, vector, cells)
    cells.sample = cells.sample[:0]
    held = shared(spark, (cells, coder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, coder = opened(held)
        task = Task.of(batches, cells)
        if task is None:
            return
        coded: list[list[tuple[np.ndarray, ...]]] = [[] for _ in task.own]
        asking = np.flatnonzero(task.role & 1)
        # Neighbours ask together, as their candidates often coincide.
        asking = asking[np.argsort(task.home[asking], kind="stable")]
        for s in range(0, len(asking), ASKING):
            part = np.sort(asking[s : s + ASKING])
            asks, place = np.zeros(len(task.ids), bool), np.full(len(task.ids), -1)
            asks[part], place[part] = True, np.arange(len(part))
            tables = np.concatenate([coder.tables(task.units[part[t : t + CODED]]) for t in range(0, len(part), CODED)])
            for j in range(len(task.own)):
                cell = task.cell(j, asks)
                cell.at = place[cell.at]
                a, b, cos = search_cell(cell, coder, tables, k, threshold, coded=coded[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos)], names=["id", "other", "similarity"])

    found = spread.groupBy("grp", "block_l", "block_r").applyInArrow(run, "id bigint, other bigint, similarity double")
    ranked = _ranked(found, k)
    copies = left_out(rows, row_id, vector, cells)
    if copies is None:
        return ranked
    # A further copy has the same best others as the greatest id that represents it.
    ranked = cut_lineage(ranked)
    reps = F.broadcast(copies.select(F.col("rep").alias("id")).distinct())
    theirs = ranked.join(reps, "id", "left_semi").select(F.col("id").alias("rep"), "other", "similarity")
    more = copies.join(F.broadcast(theirs), "rep").where("id <> other").select("id", "other", "similarity")
    return _ranked(ranked.select("id", "other", "similarity").unionByName(more), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
