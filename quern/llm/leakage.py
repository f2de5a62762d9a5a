"""Evaluation texts leaking into a corpus.

Every window of ``window`` consecutive words of every document is compared with every such window of the items:

1. *CGK embedding.* A random walk over the window writes one symbol per step and moves on by one word or not, decided
   by a random bit of (step, symbol). Equal windows give equal walks, and windows within a small edit distance give
   walks of small Hamming distance.
2. *Bit sampling.* A fixed random choice of steps of the walk makes the key of a repetition; windows meet where the
   keys agree. The walk is evaluated step by step for all windows of a batch, and a window is given up as soon as its
   sampled symbols match no item's.
3. *Edit verification.* Windows that met are compared word by word: equality for ``max_edits = 0``, otherwise the edit
   distance in words to the best end of the document's window.

The items' keys are the only thing every task holds; their number is checked (``MAX_ITEM_WINDOWS``) and beyond it the
items are processed in several passes over the corpus' hashed words, which are written once; one pass's keys at a time
are held, and none is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import word_hashes, words
from quern.session import cut_lineage, opened, shared

#: Item windows held by each task in one pass: 16 bytes a window and repetition.
MAX_ITEM_WINDOWS = 2_000_000
SEED = 20_240_229
PAD = np.int64(0)


class Walk:
    """The random walk and the sampled steps of one repetition."""

    def __init__(self, window: int, samples: int, repetition: int, edits: int):
        rng = np.random.default_rng([SEED, repetition])
        self.window = window
        # A walk of n words takes about 2n steps. Equal windows differ nowhere, so there early steps, which are
        # cheaper, do.
        reach = 2 * window if edits else window
        self.steps = np.sort(rng.choice(reach, min(samples, reach), replace=False))
        self.bits = rng.integers(1, 1 << 63, size=int(self.steps[-1]) + 1, dtype=np.int64) | np.int64(1)
        self.mix = rng.integers(1, 1 << 63, size=len(self.steps), dtype=np.int64) | np.int64(1)

    def stages(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """After each sampled step: its number, the alive window numbers and their keys so far; takes back (by
        ``send``) which of them stay alive. A window stops at its text's end, one of ``ends``."""
        alive = np.arange(len(starts))
        at = starts.astype(np.int64)
        end = at + self.window if ends is None else np.minimum(at + self.window, ends)
        key = np.zeros(len(starts), np.int64)
        sampled = 0
        with np.errstate(over="ignore"):
            for step, factor in enumerate(self.bits):
                inside = at < end
                symbol = np.where(inside, tokens[np.minimum(at, end - 1)], PAD)
                if step == self.steps[sampled]:
                    key = (key ^ symbol) * self.mix[sampled]
                    key ^= (key >> np.int64(29)) & np.int64(0x7FFFFFFFF)
                    stay = yield sampled, alive, key
                    sampled += 1
                    if stay is not None:
                        alive, at, end, key, symbol = alive[stay], at[stay], end[stay], key[stay], symbol[stay]
                    if sampled == len(self.steps):
                        return
                at = at + ((symbol * factor) < 0)


class ItemIndex:
    """Item windows and, per repetition, the sorted keys of every sampled step."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int, edits: int, samples: int, repetitions: int):
        self.window, self.edits = window, edits
        usable = [(i, t) for i, t in items if len(t) >= window]
        self.tokens = np.concatenate([t for _, t in usable]) if usable else np.zeros(0, np.int64)
        self.start, self.item = _window_starts([len(t) for _, t in usable], window)
        self.item = np.array([i for i, _ in usable], np.int64)[self.item] if usable else np.zeros(0, np.int64)
        self.walks = [Walk(window, samples, r, edits) for r in range(repetitions)]
        self.keys: list[list[np.ndarray]] = []
        self.order: list[np.ndarray] = []
        for walk in self.walks:
            stages, last = [], None
            for _, _, key in walk.stages(self.tokens, self.start):
                stages.append(np.unique(key))
                last = key
            self.keys.append(stages)
            self.order.append(np.argsort(last, kind="stable") if last is not None else np.zeros(0, np.int64))
            if last is not None:
                stages[-1] = last[self.order[-1]]

    def candidates(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the document window, number of the item window) of all that meet in repetition ``r``."""
        walk, keys = self.walks[r], self.keys[r]
        run = walk.stages(tokens, starts, ends)
        stay, alive, key = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        try:
            k, alive, key = next(run)
            while True:
                at = np.searchsorted(keys[k], key)
                stay = keys[k][np.minimum(at, len(keys[k]) - 1)] == key
                if k == len(keys) - 1:
                    break
                k, alive, key = run.send(np.flatnonzero(stay))
        except StopIteration:
            pass
        alive, key = alive[stay], key[stay]
        low, high = np.searchsorted(keys[-1], key), np.searchsorted(keys[-1], key, side="right")
        many = high - low
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(alive, many), self.order[r][np.repeat(low, many) + offset]

    def leaks(self, tokens: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (number of the document, item id) of the documents whose words stand one after another in
        ``tokens``."""
        starts, doc = _window_starts(lengths, self.window, self.edits)
        found: list[np.ndarray] = []
        if len(starts) and len(self.start):
            ends = np.cumsum(np.asarray(lengths))[doc]
            for r in range(len(self.walks)):
                d, i = self.candidates(tokens, starts, ends, r)
                if found and len(d):
                    known = np.concatenate(found)
                    new = ~np.isin(_pair(doc[d], self._slot(i)), _pair(known[:, 0], self._slot_of(known[:, 1])))
                    d, i = d[new], i[new]
                ok = self._verify(tokens, starts[d], ends[d], self.start[i])
                hit = np.stack([doc[d[ok]], self.item[i[ok]]], axis=1)
                if len(hit):
                    found.append(np.unique(hit, axis=0))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _slot(self, windows: np.ndarray) -> np.ndarray:
        return self._slot_of(self.item[windows])

    def _slot_of(self, items: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.unique(self.item), items)

    def _verify(self, tokens: np.ndarray, d: np.ndarray, end: np.ndarray, i: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(d), bool)
        w = np.arange(self.window)
        for s in range(0, len(d), 65_536):
            b = slice(s, s + 65_536)
            if not self.edits:
                ok[b] = (tokens[d[b, None] + w] == self.tokens[i[b, None] + w]).all(axis=1)
            else:
                ok[b] = _edit_distance(tokens, d[b], end[b], self.tokens, i[b], self.window, self.edits) <= self.edits
        return ok


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.int64(32)) | b


def _window_starts(lengths: list[int], window: int, edits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window that lies within one text, and the number of its text; the last ones may lack up to
    ``edits`` words at the text's end."""
    n = np.asarray(lengths, np.int64)
    many = np.where(n >= window, n - window + 1 + min(edits, window - 1), 0)
    text = np.repeat(np.arange(len(n)), many)
    begin = np.cumsum(n) - n
    return begin[text] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), text


def _edit_distance(
    a: np.ndarray, a_at: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_at: np.ndarray, window: int, edits: int
) -> np.ndarray:
    """Least edit distance between the item window and a run of words that begins at the document window and ends
    anywhere up to ``edits`` words beyond its length; all pairs at once, one column of the table at a time."""
    far = window + edits
    row = np.tile(np.arange(window + 1), (len(a_at), 1))
    best = row[:, window].copy()
    items = b[b_at[:, None] + np.arange(window)]
    for j in range(far):
        inside = a_at + j < a_end
        word = a[np.minimum(a_at + j, a_end - 1)]
        new = np.empty_like(row)
        new[:, 0] = j + 1
        step = np.minimum(row[:, 1:] + 1, row[:, :-1] + (items != word[:, None]))
        for k in range(window):
            new[:, k + 1] = np.minimum(step[:, k], new[:, k] + 1)
        row = np.where(inside[:, None], new, row)
        if j + 1 >= window - edits:
            best = np.where(inside, np.minimum(best, row[:, window]), best)
    return best


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of arrays of bigint without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 20,
    max_edits: int = 0,
    samples: int = 8,
    repetitions: int | None = None,
) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` where ``window`` consecutive words of the item's text stand in the document's
    text, in order and consecutive, with at most ``max_edits`` words inserted, deleted or replaced.

    Null texts and texts of fewer than ``window`` words (with edits: of the document too) take no part; null ids stay
    as they are in documents and are left out in items. Several rows of one id count together. With ``max_edits = 0``
    one repetition finds every case, since equal windows always meet; with edits the default number of repetitions is
    20 per edit, which ``tests/llm`` measures against brute force. Whole texts of any length are read; the empty
    table, of either side, gives no row.
    """
    if repetitions is None:
        repetitions = 1 if max_edits == 0 else 20 * max_edits
    spark = docs.sparkSession
    listed = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("i"), word_hashes(words(text)).alias("h")
    )
    sizes = listed.select(F.coalesce(F.sum(F.greatest(F.size("h") - window + 1, F.lit(0))), F.lit(0)).alias("n"))
    passes = max(1, -(-sizes.first()["n"] * repetitions // MAX_ITEM_WINDOWS))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id bigint"
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), word_hashes(words(text)).alias("h"))

    def one_pass(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        index = ItemIndex(
            [(r["i"], np.array(r["h"], np.int64)) for r in part.collect()], window, max_edits, samples, repetitions
        )
        # A broadcast is sent once per executor and not once per task.
        held = shared(spark, index)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = opened(held)
            for batch in batches:
                tokens, lengths = _arrays(batch.column("h"))
                d, i = index.leaks(tokens, lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d").take(pa.array(d)), pa.array(i, pa.int64())], names=["doc_id", "item_id"]
                )

        return hashed.mapInArrow(scan, schema).distinct(), held

    if passes == 1:
        return one_pass(listed)[0]
    hashed, out = cut_lineage(hashed), None
    for p in range(passes):
        found, held = one_pass(listed.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p))
        found = cut_lineage(found)
        held.destroy()
        out = found if out is None else out.unionByName(found)
    return out.distinct()
