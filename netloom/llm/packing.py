"""Packing of token pieces into as few fixed-length sequences as possible, by a grouping genetic algorithm on islands.

Pieces that don't fill a sequence are dealt by hash into blocks of a bounded
number. A block starts from best fit in falling order; where that uses more
sequences than the block's tokens need, several islands, each a task of its own,
breed better ones: a child takes whole well-filled bins of one parent, loses the
other parent's bins that hold any of their pieces, and best-fits the pieces this
displaces. After each epoch every island's best solutions migrate to the next one
through a shuffle. Badly filled bins of all blocks are then opened, and their
pieces dealt into fewer blocks, until one block is left or nothing is won.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import bytewords, common, wordids

CAPACITY, END = 4096, 1
#: Pieces of a block; islands of a block, epochs, generations of an epoch, solutions of an island, and those that migrate.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 500, 3, 2, 4, 4, 1
#: Bins with at least so many tokens stay closed when blocks are dealt anew; rounds of dealing at most.
CLOSED, LEVELS = CAPACITY - 8, 8
#: Dealing ends when more than this part of the pieces would be dealt again: then opening bins wins little.
STUCK = 0.8
#: Islands of a task at least, and tasks at most.
TASK_ISLANDS, MOST_TASKS = 8, 20_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): every document's ids with the end id, cut after each ``capacity`` ids.

    A null or empty text is the end id alone. uid names the row.
    """
    tokenizer = tokenizer or tokenizer_path()
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = wordids.text_ids(tokenizer, False, "<u4"), TaskContext.get().partitionId() << 33
        end, kinds = np.array([END], "<u4"), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                own = np.concatenate([ids, end])
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((uid, doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
                    uid += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], items: list[int], bins: np.ndarray, spaces: list[tuple[int, int]], new: int, capacity: int) -> int:
    """Put ``items``, one after another, each into the fullest bin that takes it; returns the next free bin number.

    bins: each item's bin, written to. spaces: (space left, bin), sorted.
    """
    for i in items:
        size = lengths[i]
        k = bisect_left(spaces, (size,))
        if k == len(spaces):
            left, b = capacity, new
            new += 1
        else:
            left, b = spaces.pop(k)
        bins[i] = b
        insort(spaces, (left - size, b))
    return new


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fills_of(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def rating(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how unevenly they are filled."""
    fills = fills_of(lengths, bins) / capacity
    return len(fills), -float((fills**2).sum())


def settled(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY, closed: int = CLOSED) -> bool:
    """Whether nothing is to be won: as few bins as the tokens need, and all but one well filled."""
    fills = fills_of(lengths, bins)
    return len(fills) <= math.ceil(int(lengths.sum()) / capacity) and int((fills < closed).sum()) <= 1


def first_solution(lengths: np.ndarray, capacity: int = CAPACITY, order: np.ndarray | None = None) -> np.ndarray:
    """Best fit in falling order, or in a given one."""
    bins, sizes = np.zeros(len(lengths), np.int32), lengths.tolist()
    keys = sizes if order is None else order.tolist()
    best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -keys[i]), bins, [], 0, capacity)
    return bins


def child(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, rng: np.random.Generator, capacity: int = CAPACITY) -> np.ndarray:
    """``one`` with some well-filled bins of ``other`` put in whole; displaced items are best-fitted."""
    fills = fills_of(lengths, other)
    good = np.argsort(-fills, kind="stable")[: max(1, len(fills) // 2)]
    chosen = rng.choice(good, min(len(good), int(rng.integers(1, 2 + len(fills) // 8))), replace=False)
    taken = np.isin(other, chosen)
    # Bins that hold a taken item go, and so do a few badly filled ones (the mutation).
    own = fills_of(lengths, one)
    bad = np.argsort(own, kind="stable")[: int(rng.integers(1, 4))]
    gone = np.isin(one, np.union1d(one[taken], np.append(bad, rng.integers(len(own)))))
    out = one.astype(np.int32)
    out[taken] = other[taken] + len(own)
    displaced = np.flatnonzero(gone & ~taken)
    kept = np.unique(one[~gone & ~taken])
    left = capacity - own[kept]
    spaces = sorted(zip(left.tolist(), kept.tolist(), strict=True))
    spaces += zip((capacity - fills[chosen]).tolist(), (chosen + len(own)).tolist(), strict=True)
    spaces.sort()
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    best_fit(lengths.tolist(), displaced.tolist(), out, spaces, len(own) + len(fills), capacity)
    return _compact(out)


def evolve(lengths: np.ndarray, population: list[np.ndarray], seed: int, generations: int, size: int, capacity: int = CAPACITY) -> list[np.ndarray]:
    """The population after so many generations, best first; it ends early once the best is settled."""
    rng = np.random.default_rng(seed)
    pool = [(rating(lengths, x, capacity), x) for x in population]
    while len(pool) < size:
        order = lengths * rng.uniform(0.7, 1.3, len(lengths))
        x = first_solution(lengths, capacity, order)
        pool.append((rating(lengths, x, capacity), x))
    pool.sort(key=lambda x: x[0])
    for _ in range(generations):
        if settled(lengths, pool[0][1], capacity):
            break
        made = []
        for _ in range(size // 2):
            # Of two random ones the better is a parent, twice.
            i, j = (int(min(rng.integers(len(pool), size=2))) for _ in range(2))
            x = child(lengths, pool[i][1], pool[j if i != j else (j + 1) % len(pool)][1], rng, capacity)
            made.append((rating(lengths, x, capacity), x))
        best = {}
        for r, x in sorted([*pool, *made], key=lambda x: x[0]):
            best.setdefault(r, (r, x))
        pool = list(best.values())[:size]
    return [x for _, x in pool]


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else [], kind))


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A first solution of each block, and whether it is settled."""
    for batch in batches:
        lengths = _arrays(batch.column(1))
        bins = [first_solution(x) for x in lengths]
        done = [settled(x, b) for x, b in zip(lengths, bins, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), _listed(bins, pa.int32()), pa.array(done, pa.bool_())], ["block", "bins", "done"])


def _epoch(seed: int):  # noqa: ANN202
    """An island's solutions after an epoch: (block, island, place, bins, n_bins, uneven), the best at place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, island, lengths, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), batch.column(3), strict=True):
                own = int(bytewords.mix(np.array([block * ISLANDS + island + (seed << 40)], np.uint64))[0])
                population = evolve(lengths, [x.values.to_numpy() for x in found.values], own, GENERATIONS, POPULATION)
                rated = [rating(lengths, x) for x in population]
                n = len(population)
                columns = [pa.array(np.full(n, block)), pa.array(np.full(n, island), pa.int32()), pa.array(range(n), pa.int32()), _listed(population, pa.int32()), pa.array([r[0] for r in rated], pa.int32()), pa.array([r[1] for r in rated])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "island", "place", "bins", "n_bins", "uneven"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, length, sequence_id, offset, filled): each piece's place; a sequence is named by its smallest uid."""
    for batch in batches:
        for uids, lengths, bins in zip(*(_arrays(batch.column(k)) for k in (1, 2, 3)), strict=True):
            order = np.lexsort((uids, bins))
            uids, lengths, bins = uids[order], lengths[order], bins[order]
            first = np.searchsorted(bins, bins)
            before = np.cumsum(lengths) - lengths
            columns = [uids, lengths, uids[first], before - before[first], fills_of(lengths, bins)[bins]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "length", "sequence_id", "offset", "filled"])


def _solve(items: DataFrame, n: int, level: int) -> DataFrame:
    """``items`` (uid, length) packed within ``n`` blocks; see ``_placed``."""
    dealt = items.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    blocks = common.materialize(dealt.select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")), "blocks")
    firsts = common.materialize(blocks.select("block", "lengths").mapInArrow(_begin, "block long, bins array<int>, done boolean"), "firsts")
    begun = firsts.filter("NOT done").select("block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.array("bins").alias("population"))
    tasks = max(1, min(MOST_TASKS, -(-n * ISLANDS // TASK_ISLANDS)))
    found = None
    for epoch in range(EPOCHS):
        islands = blocks.select("block", "lengths").join(begun, "block").select("block", "island", "lengths", "population").repartition(tasks, "block", "island")
        found = common.materialize(islands.mapInArrow(_epoch(level * EPOCHS + epoch), "block long, island int, place int, bins array<int>, n_bins int, uneven double"), "islands")
        # The elites of an island also go to the next one.
        guests = found.filter(F.col("place") < ELITES).withColumn("island", (F.col("island") + 1) % ISLANDS)
        begun = found.unionByName(guests).groupBy("block", "island").agg(F.sort_array(F.collect_set("bins")).alias("population"))
    best = found.groupBy("block").agg(F.min(F.struct("n_bins", "uneven", "bins"))["bins"].alias("bins"))
    solved = firsts.filter("done").select("block", "bins").unionByName(best)
    placed = blocks.join(solved, "block").select("block", "uids", "lengths", "bins")
    return common.materialize(placed.mapInArrow(_placed, "uid long, length long, sequence_id long, offset long, filled long"), "placed")


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset in that sequence.

    Every document with its end id is one piece, or several of CAPACITY ids and a
    rest. Full pieces are sequences by themselves. Null and empty texts are one id;
    null and repeated ids are documents of their own; an empty table gives no rows.
    Only doc_id and text are read, texts whole.
    """
    pieces = common.materialize(pieces_of(docs, tokenizer), "pieces")
    items = pieces.filter(F.col("length") < CAPACITY).select("uid", "length")
    count, level, done = items.count(), 0, []
    while count:
        n = -(-count // BLOCK)
        placed = _solve(items, n, level)
        items = placed.filter(F.col("filled") < CLOSED).select("uid", "length")
        before, count, level = count, items.count(), level + 1
        if n == 1 or level == LEVELS or count > STUCK * before:
            done.append(placed)
            break
        done.append(placed.filter(F.col("filled") >= CLOSED))
    out = pieces.filter(F.col("length") == CAPACITY).select(*pieces.columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if done:
        places = done[0]
        for x in done[1:]:
            places = places.unionByName(x)
        places = common.maybe_broadcast(common.materialize(places.select("uid", "sequence_id", "offset"), "places"))
        out = out.unionByName(pieces.filter(F.col("length") < CAPACITY).join(places, "uid"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
