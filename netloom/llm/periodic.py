"""Periodic runs of words: maximal stretches that repeat a period several times.

Documents are taken in blocks of about a megabyte. Every document has an alphabet
of its own, so one string holds a whole block and no match crosses a border:

1. ranks of the substrings of 1, 2, 4, ... words (doubling) give the suffix array
   and the longest common extension of any two positions;
2. the longest previous factor of each position, from the suffix array's nearest
   neighbours that begin earlier, cuts the string into Lempel-Ziv blocks;
3. Main's extensions to both sides of each border between blocks find every run
   that touches one;
4. the runs inside a block are copies of those inside its earlier occurrence, taken
   over from buckets by start, from left to right.

Nothing is shuffled, and memory follows the block or the longest document.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import bytewords, common

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: (doc_id, number of words) -> for each word the index of the one that takes its place, or None.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, where its group of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


class Ranks:
    """Ranks of all substrings of 1, 2, 4, ... symbols, up to the length at which all differ.

    levels[k][i]: the rank of the substring of 2**k symbols at i, equal for equal
    substrings and in their order; one that the end cuts off equals no other. Each
    level has a last entry, -1, for the empty substring behind the end.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        begins = _starts(codes[order])
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = begins
        self.levels = [rank]
        active = order[self._shared(begins)]
        self.repeated = np.sort(active)
        size = 1
        while len(active):
            old = rank[active]
            key = old * (n + 1) + rank[np.minimum(active + size, n)] + 1
            order = np.argsort(key, kind="stable")
            active, key = active[order], key[order]
            begins = _starts(key)
            rank = rank.copy()
            rank[active] = old[order] + begins - _starts(old[order])
            self.levels.append(rank)
            active = active[self._shared(begins)]
            size *= 2

    @staticmethod
    def _shared(begins: np.ndarray) -> np.ndarray:
        """Places whose group has other members."""
        out = np.zeros(len(begins), bool)
        out[1:] = begins[1:] == begins[:-1]
        out[:-1] |= out[1:]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree (i and j differ)."""
        i, j = i.copy(), j.copy()
        total = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i, j, total = i + step, j + step, total + step
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j, both included, agree (i and j differ; -1: none)."""
        i, j = i.copy(), j.copy()
        total = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            same = self.levels[k][np.where(inside, a, 0)] == self.levels[k][np.where(inside, b, 0)]
            step = (inside & same).astype(np.int64) << k
            i, j, total = i - step, j - step, total + step
        return total


def previous_factors(ranks: Ranks, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, source): the longest factor at each position that begins at an earlier one too, and where.

    Of all earlier suffixes the nearest two in the suffix array agree longest.
    Symbols that occur once have none and are passed over.
    """
    at = ranks.repeated
    order = at[np.argsort(ranks.levels[-1][at])]
    lower, upper = [-1] * len(order), [-1] * len(order)
    stack: list[int] = []
    places = order.tolist()
    for r, place in enumerate(places):
        while stack and places[stack[-1]] > place:
            upper[stack.pop()] = place
        if stack:
            lower[r] = places[stack[-1]]
        stack.append(r)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for found in (np.array(lower, np.int64), np.array(upper, np.int64)):
        has = np.flatnonzero(found >= 0)
        own, other = order[has], found[has]
        common_part = ranks.forward(own, other)
        better = common_part > length[own]
        length[own[better]], source[own[better]] = common_part[better], other[better]
    return length, source


def lz_blocks(length: np.ndarray) -> np.ndarray:
    """The starts of the Lempel-Ziv blocks: each is the longest previous factor at its start, or one new symbol."""
    out, at, sizes = [], 0, length.tolist()
    while at < len(sizes):
        out.append(at)
        at += sizes[at] or 1
    return np.array(out, np.int64)


def _pairs(borders: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(border, period) for all periods from 1 to each border's most."""
    at = np.repeat(borders, most)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1


def _at_borders(codes: np.ndarray, ranks: Ranks, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period), ends excluded, of stretches with TIMES periods at least that touch a border.

    A run that touches a border has two periods on one side of it at least. To the
    right they lie in the block behind the border: at most half its length each. To
    the left: were the period as long as the block before the border, then that
    block would lie behind the run's first period, so would agree with what is a
    period before it beyond its own end, and would be longer.
    """
    n = len(codes)
    borders = np.append(starts, n)
    sizes = np.diff(borders)
    right, left = np.append(sizes // 2, 0), np.append(0, sizes - 1)
    a, p = _pairs(borders, right)
    keep = codes[a] == codes[a + p]
    a, p = a[keep], p[keep]
    ahead = ranks.forward(a, a + p)
    keep = ahead >= p
    a, p, ahead = a[keep], p[keep], ahead[keep]
    found = [(a - ranks.backward(a - 1, a + p - 1), a + p + ahead, p)]
    a, p = _pairs(borders, left)
    keep = codes[a - 1] == codes[a - 1 - p]
    a, p = a[keep], p[keep]
    behind = ranks.backward(a - 1, a - 1 - p)
    keep = behind >= p
    a, p, behind = a[keep], p[keep], behind[keep]
    found.append((a - p - behind, a + ranks.forward(a - p, a), p))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a sequence of codes as rows (start, length, period) by start, then period; ``times`` is 4 or more."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need other bounds at the borders")
    if len(codes) < max(least, times):
        return np.zeros((0, 3), np.int64)
    ranks = Ranks(codes)
    length, source = previous_factors(ranks, len(codes))
    starts = lz_blocks(length)
    a, b, p = _at_borders(codes, ranks, starts)
    keep = b - a >= np.maximum(least, times * p)
    # One stretch is found with multiples of its period too; the smallest counts.
    smallest: dict[tuple[int, int], int] = {}
    for x, y, q in sorted(zip(a[keep].tolist(), b[keep].tolist(), p[keep].tolist(), strict=True), reverse=True):
        smallest[x, y] = q
    if not smallest:
        return np.zeros((0, 3), np.int64)
    held = sorted((x, y, q) for (x, y), q in smallest.items())
    sizes = length[starts]
    for at, size, origin in zip(starts[sizes > least + 1].tolist(), sizes[sizes > least + 1].tolist(), source[starts[sizes > least + 1]].tolist(), strict=True):
        k = bisect_right(held, (origin + 1,))
        while k < len(held) and held[k][0] < origin + size - 1:
            x, y, q = held[k]
            k += 1
            # Strictly inside: what ends the run on both sides is copied with it.
            if y < origin + size:
                insort(held, (x + at - origin, y + at - origin, q))
    out = np.array(held, np.int64)
    out[:, 1] -= out[:, 0]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def echo(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's own rewriting: one document in ten (by crc32 of the id) repeats a stretch from some word to its end. Null ids: none."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def detect(docs: DataFrame, rewrite: Rewrite | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document: doc_id, n_words, its runs (start, length, period; by start, then period) and the collapsed text.

    Words lie between ASCII blanks. A run is a stretch of consecutive words with
    smallest period q, of at least ``least`` and ``times`` * q words, that no
    neighbouring word extends. The collapsed text keeps, joined by one blank, the
    words that are in no run behind its first q words. ``rewrite`` replaces words
    first. Null and empty texts have no words and no runs; every row has its own
    result, whatever its id; texts are read whole. Only doc_id and text are read.
    Words are compared by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, block in bytewords.blocks(batch.column(1), lower=False):
                ids = batch.column(0).slice(low, len(block.first) - 1)
                yield _detected(ids, block, rewrite, least, times)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _detected(ids: pa.Array, block: bytewords.Block, rewrite: Rewrite | None, least: int, times: int) -> pa.RecordBatch:
    first = block.first
    sizes = np.diff(first)
    at = np.arange(first[-1])
    moved = set()
    if rewrite:
        for i, (doc_id, n) in enumerate(zip(ids.to_pylist(), sizes.tolist(), strict=True)):
            if (places := rewrite(doc_id, n)) is not None:
                at[first[i] : first[i + 1]] = first[i] + places
                moved.add(i)
    own = np.repeat(np.arange(len(sizes)), sizes)
    runs = runs_of(bytewords.mix(block.hashes[at] + bytewords.mix(own.astype(np.uint64) + np.uint64(1))), least, times)
    cuts = np.searchsorted(runs[:, 0], first)
    cover = np.zeros(first[-1] + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(cover[:-1]) == 0
    collapsed = []
    for i in range(len(sizes)):
        words = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
        if i in moved or cuts[i] < cuts[i + 1]:
            part = slice(first[i], first[i + 1])
            words = [words[k] for k in (at[part] - first[i])[stays[part]].tolist()]
        collapsed.append(b" ".join(words))
    start = runs[:, 0] - np.repeat(first[:-1], np.diff(cuts))
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN))
    text = pa.array(collapsed, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows), text], ["doc_id", "n_words", "runs", "collapsed"])


def report(docs: DataFrame, rewrite: Rewrite | None = echo) -> DataFrame:
    """Per document: doc_id, n_runs, the run with the greatest exponent (ties: smallest start, then period; no run: nulls) and both digests; see ``detect``."""
    found = detect(docs, rewrite)
    steeper = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    found = found.withColumn("best", F.aggregate("runs", none, lambda best, x: F.when(steeper(best, x), x).otherwise(best)))
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        common.sha256_hex(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), common.sha256_hex(F.col("collapsed")).alias("collapsed_sha256"),
    )
