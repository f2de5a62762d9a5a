"""Filling fixed-capacity containers with texts sized in tokens.

Hierarchical multi-length packing. Texts longer than the capacity are split into full containers and a rest; all other
texts stay whole. The pieces are spread over shards; a shard holds about ``SHARD_CONTAINERS`` containers' worth of tokens
and at most about ``SHARD_ROWS`` rows at any size of the corpus, so at most one container in that many is left badly
filled. Within a shard:

1. pieces are routed to the tier of the shortest context size that holds them: the capacity, a half, a quarter, ...;
2. the tiers are packed one after another from the longest into windows of their context size: a tier's longest piece
   opens a window, and its gap is filled from this and the shorter tiers: the pair of lengths that closes it exactly if
   there is one, otherwise the longest piece that fits, until nothing fits;
3. a tier's windows are bound into containers of the capacity, and what their gaps add up to is filled from the shorter
   tiers once more;
4. the pieces of containers that are still not full are packed anew across the tiers, the longest first, with the gaps
   filled the same way;
5. containers are dealt to step groups of equal number so that the groups' attention cost (sum of squared piece
   lengths) is balanced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

#: Split pattern that belongs to the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_CONTAINERS, SHARD_ROWS = 2_048, 500_000
GROUP_CONTAINERS = 64
TIERS = 6


def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    table = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens)`` of every row with a non-empty text, in tokens of the byte-level vocabulary in the file
    ``tokenizer``. The file (below 2 MB) is read where the plan is made and sent to the executors once."""
    with open(tokenizer, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(held.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    kind = docs.schema[row_id].dataType.simpleString()
    some = docs.select(F.col(row_id).alias("id"), F.col(text).alias("t")).where("t is not null and t <> ''")
    return some.mapInArrow(count, f"id {kind}, n_tokens bigint")


class _Lengths:
    """Pieces by length, with the longest one not above a bound found in nearly constant time."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        order = np.argsort(lengths, kind="stable")[::-1]
        self.left = np.bincount(lengths, minlength=capacity + 1)
        self.stack: list[list[int]] = [[] for _ in range(capacity + 1)]
        for piece, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            self.stack[n].append(piece)
        self.down = list(range(capacity + 1))
        self.distinct = np.flatnonzero(self.left)

    def at_most(self, n: int) -> int:
        """The longest length with a piece left, at most ``n``; 0 if there is none."""
        down, stack, at = self.down, self.stack, n
        while at and not stack[at]:
            at = down[at] if down[at] != at else at - 1
        while n > at:
            down[n], n = at, down[n] if down[n] != n else n - 1
        return at

    def take(self, n: int) -> int:
        self.left[n] -= 1
        return self.stack[n].pop()

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths with pieces left that add up to ``gap``."""
        low = self.distinct[: np.searchsorted(self.distinct, gap // 2, side="right")]
        other = gap - low
        ok = (self.left[low] > 0) & (self.left[other] > (low == other))
        at = np.flatnonzero(ok)
        return (int(gap - low[at[-1]]), int(low[at[-1]])) if len(at) else None


def _fill(pool: _Lengths, pieces: list[int], gap: int) -> int:
    """Add pieces until nothing fits; returns what stays of the gap."""
    while gap and (fit := pool.at_most(gap)):
        for n in (fit,) if fit == gap else pool.pair(gap) or (fit,):
            pieces.append(pool.take(n))
            gap -= n
    return gap


def _tiers(lengths: np.ndarray, capacity: int) -> list[tuple[list[int], int, int]]:
    """(pieces, tier, gap) of the containers of all tiers, one tier after another."""
    pool, out = _Lengths(lengths, capacity), []
    for level in range(TIERS):
        context = max(1, capacity >> level)
        shorter = context // 2 if level < TIERS - 1 else 0
        windows = []
        while (longest := pool.at_most(context)) > shorter:
            pieces = [pool.take(longest)]
            windows.append((pieces, context - _fill(pool, pieces, context - longest)))
        bound = capacity // context
        for s in range(0, len(windows), bound):
            pieces = [p for own, _ in windows[s : s + bound] for p in own]
            gap = _fill(pool, pieces, capacity - sum(used for _, used in windows[s : s + bound]))
            out.append((pieces, level, gap))
    return out


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each piece (no piece is longer than the capacity) and the container's tier."""
    packed = _tiers(lengths, capacity)
    # What the tiers could not close is packed anew, the longest piece first, if that takes fewer containers.
    loose = np.array([p for pieces, _, gap in packed if gap for p in pieces], np.int64)
    pool, again = _Lengths(lengths[loose], capacity), []
    while longest := pool.at_most(capacity):
        pieces = [pool.take(longest)]
        gap = _fill(pool, pieces, capacity - longest)
        again.append((loose[pieces].tolist(), min(TIERS - 1, (capacity // longest).bit_length() - 1), gap))
    if len(again) < sum(gap > 0 for _, _, gap in packed):
        packed = [x for x in packed if not x[2]] + again
    box, tier = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, (pieces, level, _) in enumerate(packed):
        box[pieces], tier[pieces] = k, level
    return box, tier


def step_groups(cost: np.ndarray, size: int) -> np.ndarray:
    """Group of each container: groups of ``size`` (the last ones may lack one) of balanced total cost, by dealing the
    costliest first to and fro."""
    groups = max(1, -(-len(cost) // size))
    turn = np.arange(len(cost)) % (2 * groups)
    out = np.empty(len(cost), np.int64)
    out[np.argsort(-cost, kind="stable")] = np.minimum(turn, 2 * groups - 1 - turn)
    return out


def pack_shard(ids: np.ndarray, tokens: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces of the rows and their containers, numbered from 0. ``ids`` are the rows' places."""
    order = np.lexsort((ids, -tokens))
    ids, tokens = ids[order], tokens[order]
    full, rest = tokens // capacity, tokens % capacity
    many = full + (rest > 0)
    row = np.repeat(np.arange(len(ids)), many)
    part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    n = np.where(part < full[row], capacity, rest[row])
    box, tier = pack_lengths(n, capacity)
    cost = np.bincount(box, weights=n.astype(float) ** 2)
    return {
        "at": ids[row], "part": part, "n_tokens": n, "box": box, "tier": tier,
        "step_group": step_groups(cost, GROUP_CONTAINERS)[box],
    }


def pack_containers(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``(target_id, container_id, id, part, first_token, n_tokens, tier, step_group)``: the container of every piece of
    every row of ``sizes`` (``id, n_tokens``) for each of the ``(target_id, capacity)``.

    A row of at most the capacity is one piece (part 0); a longer one is cut into full pieces and a rest. Rows without
    tokens or with a null count are left out; a null id is kept as such; repeated ids are separate rows. Containers
    are numbered within the target, with gaps; which pieces share one depends on the places of the rows in the written
    table of ``sizes``. Empty input gives no row.
    """
    spark = sizes.sparkSession
    kind = sizes.schema["id"].dataType.simpleString()
    schema = (
        f"target_id int, container_id bigint, id {kind}, part int, first_token bigint, n_tokens int, tier int, "
        "step_group bigint"
    )
    usable = cut_lineage(sizes.where(F.col("n_tokens") > 0).select("id", "n_tokens"))
    total, rows = usable.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    if total is None or not capacities:
        return spark.createDataFrame([], schema)
    shards = [(t, c, max(1, round(total / (c * SHARD_CONTAINERS)), -(-rows // SHARD_ROWS))) for t, c in capacities]
    targets = F.array(*[
        F.struct(F.lit(t).cast("int").alias("target_id"), F.lit(c).cast("int").alias("capacity"), F.lit(s).alias("s"))
        for t, c, s in shards
    ])
    # By the row's place and not by its id: repeated ids spread as well.
    place = F.xxhash64(F.monotonically_increasing_id())
    spread = usable.select("id", "n_tokens", place.alias("p")).select("id", "n_tokens", "p", F.explode(targets).alias("t"))
    spread = spread.select(
        "id", "n_tokens", "t.target_id", "t.capacity", F.pmod("p", F.col("t.s")).cast("int").alias("shard")
    )

    def run(group: pa.Table) -> pa.Table:
        target, capacity, shard = (group.column(c)[0].as_py() for c in ("target_id", "capacity", "shard"))
        order = group.column("id").combine_chunks()
        rank = pc.sort_indices(group.select(["id", "n_tokens"]), [("id", "ascending"), ("n_tokens", "ascending")])
        tokens = group.column("n_tokens").to_numpy()[rank.to_numpy()]
        p = pack_shard(np.arange(len(tokens)), tokens, capacity)
        return pa.table(
            {
                "target_id": pa.array(np.full(len(p["at"]), target, np.int32)),
                "container_id": pa.array((np.int64(shard) << np.int64(32)) + p["box"]),
                "id": order.take(rank.take(pa.array(p["at"]))),
                "part": pa.array(p["part"].astype(np.int32)),
                "first_token": pa.array(p["part"] * np.int64(capacity)),
                "n_tokens": pa.array(p["n_tokens"].astype(np.int32)),
                "tier": pa.array(p["tier"].astype(np.int32)),
                "step_group": pa.array((np.int64(shard) << np.int64(32)) + p["step_group"]),
            }
        )

    return spread.groupBy("target_id", "capacity", "shard").applyInArrow(run, schema)


def packing_faults(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``(target_id, n_ids, n_incomplete, n_split, n_over)``: packed ids (assumed unique), those whose parts don't follow one
    another without a hole, those split although they fit a container, and containers above the capacity."""
    known = F.broadcast(packed.sparkSession.createDataFrame(capacities, "target_id int, capacity int"))
    pieces = packed.join(known, "target_id")
    boxes = pieces.groupBy("target_id", "container_id").agg((F.sum("n_tokens") > F.max("capacity")).alias("over"))
    over = boxes.groupBy("target_id").agg(F.count_if("over").alias("n_over"))
    ids = pieces.groupBy("target_id", "id").agg(
        F.count(F.lit(1)).alias("n"), F.max("part").alias("last"), F.count_distinct("part").alias("parts"),
        F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.max("capacity").alias("c"),
    )
    whole = (F.col("n") == F.col("parts")) & (F.col("n") == F.col("last") + 1) & (F.col("end") == F.col("tokens"))
    found = ids.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_ids"), F.count_if(~whole).alias("n_incomplete"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("c"))).alias("n_split"),
    )
    return found.join(over, "target_id")


def fill_summary(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``(target_id, capacity, n_containers, n_pieces, n_tokens, fill)`` per target."""
    boxes = packed.groupBy("target_id", "container_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens")
    )
    sums = boxes.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens")
    )
    known = packed.sparkSession.createDataFrame(capacities, "target_id int, capacity int")
    fill = F.round(F.col("n_tokens").cast("double") / (F.col("n_containers") * F.col("capacity")), 6)
    return sums.join(F.broadcast(known), "target_id").withColumn("fill", fill)
