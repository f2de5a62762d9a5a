"""Vectors in overlapping spatial cells of a reduced space.

Shared by the clustering and the neighbour search. A bounded sample (at most ``MAX_SAMPLE`` rows) gives the leading principal
directions of the unit vectors and, in the reduced space, the pivots of the cells (spherical k-means). The reduced space
has one more axis, the length of what the directions leave over: its vectors are unit vectors again, and the angle
between two of them is at most the angle between the whole vectors.

Every vector has a home cell (its nearest pivot). The radius of a cell is the largest angle between its pivot and a
vector at home, over all rows. A vector within an angle of ``reach`` of one at home in a cell is at most ``reach`` plus
the radius from its pivot (triangle inequality), so cells for which that holds are its margin: no pair within the reach
is lost, however many cells that takes. Cells are bound into groups of neighbouring cells.

Vectors travel in two steps, so that whole vectors go only where a partner is:

1. Whole vectors go to their home; to the groups of their margin go *sketches*, projections on ``SKETCH`` random
   orthogonal directions in 8-bit integers. The cosine of two sketches is off from that of the vectors by a known
   deviation in any direction; a pair of at least ``threshold`` stays below ``Cells.near``, ``DEVIATIONS`` of them
   lower, with a probability of 3e-7. Each vector at home learns in which tasks it has possible partners.
2. Whole vectors go to those tasks, and rest at home if they have a possible partner anywhere.

Copies of one vector that hold a large share of the rows (:func:`survey`) are represented by a few ids; what holds for
the greatest of these holds for the others (:func:`left_out`).

Whole vectors travel as 16-bit integers with one scale per vector: half the bytes, and an error of about 3e-6 in a cosine.
A task keeps them so, too. What it computes from them, and what it gives back, it makes in slices of bounded size, however
many groups, targets or cells a vector has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import opened, shared

#: Wanted mean number of vectors at home in a cell, and the bounds of the number of cells.
CELL_ROWS = 1_000
MIN_CELLS, MAX_CELLS = 8, 16_384
#: Rows that the reduction, the pivots and the codebooks are fitted on: eight a cell, between these bounds (the upper
#: one is 136 MB of vectors on the driver, reached at eight million vectors).
MIN_SAMPLE, MAX_SAMPLE = 8_192, 65_536
#: Rows whose products with all pivots are held at once.
BLOCK = 1_024
#: Rows that a task scales, unpacks or gives back at once, and products that it holds at once.
SLICE, PRODUCTS = 2_048, 4_000_000
REDUCED = 96
#: Cells of a group.
GROUP_CELLS = 20
#: Expected rows at home and asking rows of a task of a group, each; beyond that they are split into blocks that meet
#: pairwise. Of sketches a task holds five times as many.
GROUP_ROWS = 40_000
#: Directions of a sketch, and the deviations by which a pair's sketches may be farther apart than the pair.
SKETCH, DEVIATIONS = 224, 5.0
#: A vector is represented by a few ids if it may hold this share of the rows and has at least so many copies.
HEAVY_SHARE, HEAVY_ROWS = 1e-3, 64
#: Rows of the sample that tell how many vectors ask in a group.
ASKING_SAMPLE = 4_096
#: Angle by which rounded numbers and 16-bit integers may be off.
SLACK = 2e-3
SEED = 20_240_301


@dataclass
class Scaling:
    """``(element - center) / spread`` by position; identity where None."""

    center: np.ndarray | None
    spread: np.ndarray | None
    width: int

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the readable vectors and their unit vectors. Unreadable are: null, another number of
        elements, a null, NaN or infinite element, and a vector without direction (all zero after scaling)."""
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        rows, units = [np.zeros(0, np.int64)], [np.zeros((0, self.width), np.float32)]
        for s in range(0, len(lists), SLICE):
            at, x = self._units(lists.slice(s, SLICE))
            rows.append(at + s)
            units.append(x)
        return np.concatenate(rows), np.concatenate(units)

    def _units(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(sizes == self.width)
        flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(-1, self.width).astype(np.float64)
        good = np.isfinite(x).all(axis=1)
        x, rows = x[good], rows[good]
        if self.center is not None:
            x = (x - self.center) / self.spread
        norm = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / norm[:, None]
        good = np.isfinite(norm) & (norm > 0)
        return rows[good], x[good].astype(np.float32)


def scaling_of(columns: DataFrame, width: int) -> Scaling:
    """From a table ``(pos, center, spread)``. A place without a row, or with a null, keeps its element as it is."""
    rows = columns.select("pos", "center", "spread").where(F.col("pos").between(0, width - 1)).collect()
    center, spread = np.zeros(width), np.ones(width)
    for r in rows:
        if r["center"] is not None and r["spread"]:
            center[r["pos"]], spread[r["pos"]] = r["center"], r["spread"]
    return Scaling(center, spread, width)


def pack(units: np.ndarray) -> np.ndarray:
    """Rows of ``width`` int16 and the float32 scale in two more."""
    scale = np.abs(units).max(axis=1) / 32767
    whole = np.rint(units / scale[:, None]).astype(np.int16)
    return np.concatenate([whole, scale.astype(np.float32)[:, None].view(np.int16)], axis=1)


def unpack(flat: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors of rows made by :func:`pack`."""
    x = flat[:, :width].astype(np.float32) * np.ascontiguousarray(flat[:, width:]).view(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of the pivot of the greatest product with each row."""
    parts = [np.argmax(x[s : s + BLOCK] @ pivots.T, axis=1) for s in range(0, len(x), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``k`` unit pivots of the unit rows of ``x``; an emptied pivot restarts at a random row."""
    pivots = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = nearest_pivot(x, pivots)
        order = np.argsort(home, kind="stable")
        begin = np.searchsorted(home[order], np.arange(len(pivots)))
        filled = np.flatnonzero(np.bincount(home, minlength=len(pivots)))
        sums = np.add.reduceat(x[order], begin[filled], axis=0)
        pivots = x[rng.choice(len(x), len(pivots))].copy()
        pivots[filled] = sums
        pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    return pivots


def split_large(x: np.ndarray, pivots: np.ndarray, most: float, rng: np.random.Generator) -> np.ndarray:
    """Pivots of which none is the nearest to more than ``most`` rows, as far as the rows of a cell differ: larger cells
    are halved again and again."""
    home = nearest_pivot(x, pivots)
    done: list[np.ndarray] = []
    waiting = [np.flatnonzero(home == c) for c in range(len(pivots))]
    while waiting:
        rows = waiting.pop()
        if len(rows) > most:
            halves = spherical_kmeans(x[rows], 2, rng)
            side = nearest_pivot(x[rows], halves)
            if 0 < side.sum() < len(rows):
                waiting += [rows[side == 0], rows[side == 1]]
                continue
        if len(rows):
            done.append(unit_sum(x[rows]))
    return np.stack(done)


def unit_sum(x: np.ndarray) -> np.ndarray:
    total = x.sum(axis=0)
    return total / max(float(np.linalg.norm(total)), 1e-12)


@dataclass
class Cells:
    scaling: Scaling
    directions: np.ndarray  # width x reduced
    random: np.ndarray  # width x sketch, orthonormal columns
    reach: float  # angle within which vectors must meet
    near: float  # least cosine of the sketches of vectors within the reach
    sample: np.ndarray  # unit vectors that all was fitted on; dropped before it is sent
    pivots: np.ndarray  # cells x (reduced + 1)
    group: np.ndarray  # group of each cell
    bit: np.ndarray  # of each cell within its group; more than 62 cells share bits
    radius: np.ndarray  # of each cell
    blocks: np.ndarray  # groups x 3: blocks of the rows at home, of the sketches and of the asking rows
    heavy: dict[int, int] = field(default_factory=dict)  # greatest id that represents a vector of many copies

    def reduced(self, units: np.ndarray) -> np.ndarray:
        y = units @ self.directions
        rest = np.sqrt(np.maximum(1 - (y * y).sum(axis=1, keepdims=True), 0))
        y = np.concatenate([y, rest], axis=1)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def asked(self, reduced: np.ndarray, home: np.ndarray, cells: np.ndarray, slack: float) -> np.ndarray:
        """Whether each row asks in each of ``cells``: those that may hold a vector within the reach, and its home."""
        least = np.cos(np.minimum(self.radius[cells] + self.reach + slack, np.pi)).astype(np.float32)
        near = reduced @ self.pivots[cells].T >= least
        near |= self.radius[cells] + self.reach + slack >= np.pi
        return near | (home[:, None] == cells)

    def margins(self, reduced: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, group, bits of the cells) of all groups in which each row asks, some rows at a time."""
        order = np.argsort(self.group, kind="stable")
        used, begin = np.unique(self.group[order], return_index=True)
        for s in range(0, len(reduced), BLOCK // 4):
            near = self.asked(reduced[s : s + BLOCK // 4], home[s : s + BLOCK // 4], order, 2 * SLACK)
            bits = np.bitwise_or.reduceat(np.where(near, self.bit[order], 0), begin, axis=1)
            at, g = np.nonzero(bits)
            yield at + s, used[g], bits[at, g]

    def sketches(self, units: np.ndarray) -> np.ndarray:
        y = units @ self.random
        step = np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-30) / 127
        return np.rint(y / step).astype(np.int8)

    def kept(self, marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each row stands for itself, as all do but further copies of a vector of many copies."""
        stay = np.ones(len(ids), bool)
        if self.heavy:
            names = np.array(sorted(self.heavy))
            at = np.minimum(np.searchsorted(names, marks), len(names) - 1)
            last = np.array([self.heavy[m] for m in names.tolist()])
            stay = (names[at] != marks) | (ids <= last[at])
        return stay


def lengthened(sketch: np.ndarray) -> np.ndarray:
    """Sketches as unit vectors of floats."""
    x = sketch.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def marks_of(units: np.ndarray) -> np.ndarray:
    """64-bit hash of each vector."""
    with np.errstate(over="ignore"):
        whole = np.ascontiguousarray(units).view(np.int32).astype(np.int64)
        mark = whole @ np.random.default_rng(SEED).integers(1, 1 << 62, units.shape[1])
    return mark ^ (mark >> np.int64(31))


def survey(vectors: DataFrame, vector: str, cells: Cells) -> tuple[np.ndarray, list[int]]:
    """In one pass over all rows: the radius of each cell, and the marks of the vectors of many copies.

    Each task names the vectors that hold half of ``HEAVY_SHARE`` of its rows, with their number. Those named for half
    of that share of all rows come out, among them every vector that holds the share; that is a bounded number.
    """
    held = shared(vectors.sparkSession, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = opened(held)
        least, seen = np.full(len(c.pivots), 2.0), 0
        names, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            units = c.scaling.units(batch.column(0))[1]
            y = c.reduced(units)
            home = nearest_pivot(y, c.pivots)
            np.minimum.at(least, home, (y * c.pivots[home]).sum(axis=1, dtype=float))
            seen += len(units)
            names, at = np.unique(np.concatenate([names, marks_of(units)]), return_inverse=True)
            many = np.bincount(at, weights=np.concatenate([many, np.ones(len(units), np.int64)])).astype(np.int64)
            if len(names) > 1_000_000:
                names, many = names[many > seen * HEAVY_SHARE / 4], many[many > seen * HEAVY_SHARE / 4]
        cell, often = np.flatnonzero(least < 2), (many > 1) & (many >= seen * HEAVY_SHARE / 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[cell, np.full(often.sum(), -1)].astype(np.int32)),
                pa.array(np.r_[least[cell], np.full(often.sum(), 2.0)]),
                pa.array(np.r_[np.zeros(len(cell), np.int64), names[often]]),
                pa.array(np.r_[np.zeros(len(cell), np.int64), many[often]]),
                pa.array(np.r_[[seen], np.zeros(len(cell) + often.sum(), np.int64)][: len(cell) + often.sum()].astype(np.int64)),
            ],
            names=["cell", "least", "mark", "n", "seen"],
        )

    rows = vectors.select(vector).mapInArrow(run, "cell int, least double, mark bigint, n bigint, seen bigint")
    found = rows.groupBy("cell", "mark").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    found = found.where((F.col("cell") >= 0) | (F.col("n") >= HEAVY_ROWS)).collect()
    radius, seen = np.zeros(len(cells.pivots)), sum(r["seen"] for r in found)
    for r in found:
        if r["cell"] >= 0:
            radius[r["cell"]] = np.arccos(np.clip(r["least"], -1, 1))
    return radius, [r["mark"] for r in found if r["cell"] < 0 and r["n"] >= seen * HEAVY_SHARE / 2]


def representatives(vectors: DataFrame, row_id: str, vector: str, scaling: Scaling, marks: list[int], keep: int) -> dict[int, int]:
    """Of each of ``marks``, the ``keep``-th smallest id; only marks of more ids come out."""
    wanted = np.array(sorted(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = scaling.units(batch.column(1))
            mark = marks_of(units)
            heavy = np.isin(mark, wanted)
            pairs = np.unique(np.stack([mark[heavy], batch.column(0).to_numpy()[rows[heavy]]], axis=1), axis=0)
            begin = np.searchsorted(pairs[:, 0], pairs[:, 0])
            first = pairs[np.arange(len(pairs)) - begin <= keep]
            yield pa.RecordBatch.from_arrays([pa.array(first[:, 0]), pa.array(first[:, 1])], names=["mark", "id"])

    some = vectors.select(F.col(row_id).cast("bigint").alias("id"), vector).mapInArrow(run, "mark bigint, id bigint")
    rank = F.dense_rank().over(Window.partitionBy("mark").orderBy("id"))
    first = some.withColumn("rank", rank).where(F.col("rank") <= keep + 1)
    at = first.groupBy("mark").agg(F.max("rank").alias("most"), F.max(F.when(F.col("rank") == keep, F.col("id"))).alias("last"))
    return {r["mark"]: r["last"] for r in at.where(F.col("most") > keep).collect()}


def left_out(vectors: DataFrame, row_id: str, vector: str, cells: Cells) -> DataFrame | None:
    """``(id, rep)`` of the copies that are represented by others, with the greatest id of these; None if there are none."""
    if not cells.heavy:
        return None
    held = shared(vectors.sparkSession, replace(cells, sample=cells.sample[:0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = opened(held)
        for batch in batches:
            rows, units = c.scaling.units(batch.column(1))
            mark, ids = marks_of(units), batch.column(0).to_numpy()[rows]
            out = ~c.kept(mark, ids)
            reps = np.array([c.heavy[m] for m in mark[out].tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(reps)], names=["id", "rep"])

    some = vectors.select(F.col(row_id).cast("bigint").alias("id"), vector)
    return some.mapInArrow(run, "id bigint, rep bigint").distinct()


def fit_cells(vectors: DataFrame, row_id: str, vector: str, scaling: Scaling, threshold: float, keep: int) -> Cells | None:
    """Cells in which all vectors of a cosine of at least ``threshold`` meet. Fit on at most ``MAX_SAMPLE`` rows, drawn with
    a fixed seed and whatever their content, so that copies of one vector can't fill the sample beyond their share.
    ``keep`` ids represent a vector of many copies. None where no vector is readable."""
    n = vectors.count()
    size = int(np.clip(8 * n / CELL_ROWS, MIN_SAMPLE, MAX_SAMPLE))
    share = min(1.0, 1.25 * size / max(n, 1))
    some = vectors.select(vector).where(F.size(vector) == scaling.width)
    lists = (some.sample(share, SEED) if share < 1 else some).toArrow().column(vector)
    rng = np.random.default_rng(SEED)
    sample = np.concatenate([np.zeros((0, scaling.width), np.float32), *(scaling.units(c)[1] for c in lists.chunks)])
    if not len(sample):
        return None
    sample = sample[rng.permutation(len(sample))[:size]]
    _, v = np.linalg.eigh((sample.T @ sample / len(sample)).astype(np.float64))
    directions = np.ascontiguousarray(v[:, ::-1][:, : min(REDUCED, scaling.width)], dtype=np.float32)
    wide = min(SKETCH, scaling.width)
    random = np.linalg.qr(rng.normal(size=(scaling.width, wide)))[0].astype(np.float32)
    # Rounded to six digits a cosine may reach the threshold from below.
    least = float(np.clip(threshold - 1e-6, -1, 1))
    near = least - DEVIATIONS * (1 - least**2) * float(np.sqrt((1 - wide / scaling.width) / wide)) - 0.01
    none = np.zeros(0, int)
    cells = Cells(scaling, directions, random, float(np.arccos(least)), near, sample, sample[:0], none, none, none, none)
    y = cells.reduced(sample)
    k = int(np.clip(n / CELL_ROWS, MIN_CELLS, MAX_CELLS))
    cells.pivots = split_large(y, spherical_kmeans(y, k, rng), max(8.0, 1.5 * len(y) / k), rng)
    tops = spherical_kmeans(cells.pivots, max(1, len(cells.pivots) // GROUP_CELLS), rng)
    cells.group = nearest_pivot(cells.pivots, tops)
    place = np.zeros(len(cells.group), np.int64)
    for g in range(len(tops)):
        place[cells.group == g] = np.arange((cells.group == g).sum())
    cells.bit = np.int64(1) << (place % 62)
    sent = replace(cells, sample=sample[:0])
    cells.radius, marks = survey(vectors, vector, sent)
    if marks:
        cells.heavy = representatives(vectors, row_id, vector, scaling, marks, keep)
    cells.blocks = _blocks_of(cells, y, len(tops), GROUP_ROWS * len(sample) / n)
    return cells


def _blocks_of(cells: Cells, y: np.ndarray, groups: int, most: float) -> np.ndarray:
    """Blocks of each group: ``most`` rows of the sample at home, five times as many sketches, and ``most`` rows that ask
    because the sample holds a possible partner."""
    home = nearest_pivot(y, cells.pivots)
    at = cells.group[home]
    stored = np.bincount(at, minlength=groups)
    some = lengthened(cells.sketches(cells.sample[:ASKING_SAMPLE]))
    others = lengthened(cells.sketches(cells.sample[: 4 * ASKING_SAMPLE]))
    theirs = np.argsort(at[: len(others)], kind="stable")
    used, begin = np.unique(at[theirs], return_index=True)
    hit = np.zeros((len(some), groups), bool)
    for s in range(0, len(some), BLOCK):
        near = some[s : s + BLOCK] @ others[theirs].T >= cells.near
        hit[s : s + BLOCK, used] = np.logical_or.reduceat(near, begin, axis=1)
    hit[np.arange(len(some)), at[: len(some)]] = False
    sketches, margin = np.zeros(groups, np.int64), np.zeros((len(some), groups), bool)
    for row, grp, _ in cells.margins(y, home):
        sketches += np.bincount(grp, minlength=groups)
        margin[row[row < len(some)], grp[row < len(some)]] = True
    asking = (hit & margin).sum(axis=0) * len(cells.sample) / len(some) + stored
    return np.maximum(1, np.ceil(np.stack([stored, sketches / 5, asking], axis=1) / most).astype(int))


MEETING = "grp int, block_l int, block_r int, id bigint, home int, cells bigint, vec binary"
TASKS = "grp int, block_l int, block_r int, id bigint, role int, home int, vec binary"


def assign(vectors: DataFrame, row_id: str, vector: str, cells: Cells) -> DataFrame:
    """``(grp, block_l, block_r int, id bigint, role, home int, vec binary)``: the vectors that may have a partner, at home
    and in every task that holds such a partner at home.

    ``role`` is 1 for an asking row, 2 for a stored row, 3 for both. A task is a pair of blocks, of the stored rows of a
    group and of the asking rows: a stored row is sent to all tasks of its left block, an asking row to that of its
    right block, so it meets every stored row that it asks for exactly once.
    """
    held = shared(vectors.sparkSession, replace(cells, sample=cells.sample[:0]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = opened(held)
        for batch in batches:
            for s in range(0, len(batch), SLICE):
                yield from _sent(batch.slice(s, SLICE), c)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(batches, opened(held))

    rows = vectors.select(F.col(row_id).cast("bigint").alias("id"), vector).mapInArrow(send, MEETING)
    return rows.groupBy("grp", "block_l", "block_r").applyInArrow(meet, TASKS)


def _sent(batch: pa.RecordBatch, c: Cells) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`MEETING` of the vectors of a slice."""
    rows, units = c.scaling.units(batch.column(1))
    ids = batch.column(0).to_numpy()[rows]
    stay = c.kept(marks_of(units), ids) if c.heavy else np.ones(len(ids), bool)
    ids, units = ids[stay], units[stay]
    if not len(ids):
        return
    y = c.reduced(units)
    home = nearest_pivot(y, c.pivots)
    own = c.group[home]

    def sent(grp: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: np.ndarray, vec: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(at), 4 * SLICE):
            part = slice(s, s + 4 * SLICE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grp[part].astype(np.int32)),
                    pa.array(left[part].astype(np.int32)),
                    pa.array(right[part].astype(np.int32)),
                    pa.array(ids[at[part]]),
                    pa.array(home[at[part]].astype(np.int32)),
                    pa.array(bits[part]),
                    _binary(vec[at[part]]),
                ],
                names=["grp", "block_l", "block_r", "id", "home", "cells", "vec"],
            )

    # Whole vectors at home, in all blocks of sketches.
    a, a_right = _copies(np.arange(len(ids)), c.blocks[own, 1])
    yield from sent(own[a], _block(ids[a], c.blocks[own[a], 0]), a_right, a, np.zeros(len(a), np.int64), pack(units))
    # Sketches in their margins, in all blocks of rows at home. Sketches of one task's vectors stay together: a vector at
    # home learns of that task once.
    sketches, place = c.sketches(units), _place(own, ids, c)
    for at, grp, bits in c.margins(y, home):
        b, b_left = _copies(np.arange(len(at)), c.blocks[grp, 0])
        yield from sent(grp[b], b_left, _block(place[at[b]], c.blocks[grp[b], 1]), at[b], bits[b], sketches)


def _copies(rows: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as said, and the number of the copy."""
    return np.repeat(rows, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _block(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % blocks.astype(np.uint64)).astype(np.int64)


def _place(groups: np.ndarray, ids: np.ndarray, c: Cells) -> np.ndarray:
    """The group and left block in which each vector is at home, as one number."""
    return groups * np.int64(1 << 32) + _block(ids, c.blocks[groups, 0])


def _meet(batches: Iterator[pa.RecordBatch], c: Cells) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`TASKS` of the vectors at home whose sketch meets another's."""
    grp, home_block, right_block, mine, theirs = 0, 0, 0, [], []
    for batch in batches:
        if not len(batch):
            continue
        grp, home_block, right_block = (batch.column(n)[0].as_py() for n in ("grp", "block_l", "block_r"))
        bits, ids, cell = (batch.column(n).to_numpy() for n in ("cells", "id", "home"))
        for part, at, kind in ((mine, np.flatnonzero(bits == 0), np.int16), (theirs, np.flatnonzero(bits), np.int8)):
            if len(at):
                part.append((ids[at], cell[at], bits[at], _rows(batch.column("vec"), at, kind)))
    if not mine or not theirs:
        return
    ids, cell = (np.concatenate([m[j] for m in mine]) for j in range(2))
    raw = _joined([m[3] for m in mine])
    mine.clear()
    sketch = np.concatenate([c.sketches(unpack(raw[s : s + SLICE], c.scaling.width)) for s in range(0, len(raw), SLICE)])
    # Tasks in which vectors are at home, numbered by group and block.
    before = np.cumsum(c.blocks[:, 0]) - c.blocks[:, 0]
    own = np.zeros((len(ids), int(c.blocks[:, 0].sum())), bool)
    inside = [np.flatnonzero(cell == k) for k in np.flatnonzero(c.group == grp)]
    inside = [(c.bit[cell[rows[0]]], rows) for rows in inside if len(rows)]
    for other_ids, other_cell, bits, other in theirs:
        there = c.group[other_cell]
        target = before[there] + _block(other_ids, c.blocks[there, 0])
        order = np.argsort(target, kind="stable")
        other_ids, bits, target, other = other_ids[order], bits[order], target[order], lengthened(other[order])
        for bit, at in inside:
            cols = np.flatnonzero(bits & bit)
            if not len(cols):
                continue
            across, used, first = other[cols].T, *np.unique(target[cols], return_index=True)
            by_id = np.argsort(other_ids[cols], kind="stable")
            sorted_ids = other_ids[cols[by_id]]
            step = max(16, PRODUCTS // len(cols))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                hit = lengthened(sketch[part]) @ across >= c.near
                low = np.searchsorted(sorted_ids, ids[part])
                self_at, nth = _copies(np.arange(len(part)), np.searchsorted(sorted_ids, ids[part], side="right") - low)
                hit[self_at, by_id[low[self_at] + nth]] = False
                own[part[:, None], used] |= np.logical_or.reduceat(hit, first, axis=1)
    # A vector with a partner anywhere is stored at home, in all blocks of asking rows, and asks there if it has one there.
    # Where other blocks of sketches may hold its partners as well, one of them stores it whatever they hold.
    stored, at_home = own.any(axis=1), np.zeros(len(ids), bool)
    if c.blocks[grp, 1] == 1:
        here = before[grp] + home_block
        at_home = own[:, here].copy()
        own[:, here] = False
    else:
        stored = _block(ids, np.full(len(ids), c.blocks[grp, 1])) == right_block
    group_of = np.repeat(np.arange(len(c.blocks)), c.blocks[:, 0])
    for s in range(0, len(ids), SLICE):
        row, t = np.nonzero(own[s : s + SLICE])
        row, to = row + s, group_of[t]
        right = _block(ids[row], c.blocks[to, 2])
        kept, kept_right = _copies(s + np.flatnonzero(stored[s : s + SLICE]), np.full(stored[s : s + SLICE].sum(), c.blocks[grp, 2]))
        asks = at_home[kept] & (kept_right == _block(ids[kept], np.full(len(kept), c.blocks[grp, 2])))
        columns = [
            np.r_[to, np.full(len(kept), grp)].astype(np.int32),
            np.r_[t - before[to], np.full(len(kept), home_block)].astype(np.int32),
            np.r_[right, kept_right].astype(np.int32),
        ]
        who, role = np.r_[row, kept], np.r_[np.full(len(row), 1), np.where(asks, 3, 2)].astype(np.int32)
        for p in (slice(x, x + 2 * SLICE) for x in range(0, len(who), 2 * SLICE)):
            rest = [ids[who[p]], role[p], cell[who[p]].astype(np.int32)]
            arrays = [pa.array(x) for x in [*(x[p] for x in columns), *rest]]
            yield pa.RecordBatch.from_arrays(
                [*arrays, _binary(raw[who[p]])], names=["grp", "block_l", "block_r", "id", "role", "home", "vec"]
            )


def _rows(column: pa.Array, at: np.ndarray, kind: type) -> np.ndarray:
    """The binary values at ``at``, which have the same length, as rows of numbers."""
    data = column.take(pa.array(at))
    ends = np.frombuffer(data.buffers()[1], np.int32)[: len(at) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[: ends[-1]].view(kind).reshape(len(at), -1)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of all parts; each part is let go when it is copied, so that they are never held twice."""
    end = sum(map(len, parts))
    out = np.empty((end, parts[-1].shape[1]), parts[-1].dtype)
    while parts:
        part = parts.pop()
        out[end - len(part) : end] = part
        end -= len(part)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    step = flat.strides[0]
    offsets = pa.array(np.arange(len(flat) + 1) * step, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, offsets.buffers()[1], pa.py_buffer(flat)])


@dataclass
class Packed:
    """Unit vectors at the places ``at`` of packed rows. Those that are asked for are unpacked."""

    raw: np.ndarray
    at: np.ndarray
    width: int

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return unpack(self.raw[self.at[rows]], self.width)


@dataclass
class Cell:
    """What a task holds of one cell: vectors at home and those that ask in it, each id and vector once. ``left`` rows ask,
    ``right`` rows are stored."""

    at: np.ndarray  # places among the rows of the task
    ids: np.ndarray
    units: np.ndarray | Packed
    marks: np.ndarray  # hash of the vector
    home: np.ndarray
    left: np.ndarray
    right: np.ndarray


@dataclass
class Task:
    """The rows of a task, by id and vector, each once."""

    ids: np.ndarray
    units: Packed
    marks: np.ndarray
    home: np.ndarray
    role: np.ndarray
    core: np.ndarray | None  # where the rows tell of it
    own: np.ndarray  # cells of the group
    near: np.ndarray  # rows x cells: whether the row is in the cell's margin

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], cells: Cells) -> Task | None:
        """None without rows."""
        grp, raw, parts = 0, [], []
        for batch in batches:
            if len(batch):
                grp = batch.column("grp")[0].as_py()
                names = [n for n in ("id", "home", "role", "is_core") if n in batch.schema.names]
                parts.append([np.array(batch.column(n).to_numpy(zero_copy_only=False)) for n in names])
                raw.append(_rows(batch.column("vec"), np.arange(len(batch)), np.int16))
        if not parts:
            return None
        ids, home, role, *core = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        raw = _joined(raw)
        weights = np.random.default_rng(SEED).integers(1, 1 << 62, raw.shape[1])
        with np.errstate(over="ignore"):
            mark = np.concatenate([raw[s : s + SLICE].astype(np.int64) @ weights for s in range(0, len(raw), SLICE)])
        order = np.lexsort((mark, ids))
        first = np.flatnonzero(np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(mark[order]) != 0)])
        at, role = order[first], np.bitwise_or.reduceat(role[order], first)
        units, home = Packed(raw, at, cells.scaling.width), home[at]
        own = np.flatnonzero(cells.group == grp)
        near = np.concatenate(
            [
                cells.asked(cells.reduced(units[np.arange(s, min(s + BLOCK, len(at)))]), home[s : s + BLOCK], own, SLACK)
                for s in range(0, len(at), BLOCK)
            ]
        )
        return cls(ids[at], units, mark[at], home, role, core[0][at] if core else None, own, near)

    def cell(self, j: int, asking: np.ndarray | None = None) -> Cell:
        """What there is of the ``j``-th cell; of the rows that only ask, those of ``asking`` if given."""
        inside = self.near[:, j]
        if asking is not None:
            inside = inside & (asking | ((self.role & 2) > 0) & (self.home == self.own[j]))
        at = np.flatnonzero(inside)
        left = (self.role[at] & 1) > 0 if asking is None else asking[at]
        units = Packed(self.units.raw, self.units.at[at], self.units.width)
        return Cell(at, self.ids[at], units, self.marks[at], self.home[at] == self.own[j], left, (self.role[at] & 2) > 0)
