"""Substring deduplication by recompression.

Rounds shorten every document's word sequence: first runs of one symbol become
one symbol, then each pair of a left-hand and a right-hand symbol does (a bit of
the symbol's hash says which hand it is). A new symbol is named by a hash of
what it replaces, so all tasks of all rounds name equal content equally. Beside
each symbol goes its context, the words on which its making depended. Wherever
those words occur, the symbol does: two equal windows have equal symbols inside.

Each window is filed under its highest symbol whose context lies within it. Spark
finds the symbols (with their contexts) that several documents share; only
windows filed under those are compared, by 128-bit hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import bytewords, common

SPAN = 50
ROUNDS = 12
#: Rows of a task that are compared with one another before the shuffle, so that few rows of a crowded key or window cross it.
STRETCH = 500_000

_RUN, _LENGTH, _LEFT, _RIGHT, _OTHER = (np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(8).integers(1, 2**62, 5))


def _round(h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, after: np.ndarray, salt: int) -> tuple:
    """One round over the symbols h of documents doc, with contexts [low, high).

    before, after: for each document, a position outside of it on either side: the
    context of a symbol that depends on where its document begins or ends.
    """
    n = len(h)
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    to = np.append(at[1:], n)
    d = doc[at]
    # A run ends where another symbol stands: it depends on both neighbours.
    inner = np.zeros(len(at), bool)
    inner[1:] = d[1:] == d[:-1]
    lo = np.where(inner, low[np.maximum(at - 1, 0)], before[d])
    inner = np.zeros(len(at), bool)
    inner[:-1] = d[1:] == d[:-1]
    hi = np.where(inner, high[np.minimum(to, n - 1)], after[d])
    length = (to - at).astype(np.uint64)
    h = np.where(length > 1, bytewords.mix(h[at] * _RUN + length * _LENGTH), h[at])
    # Left-hand symbols join a right-hand one behind them; a single one depends on the neighbour that it could have joined.
    right = bytewords.mix(h + np.uint64(salt)) >> np.uint64(63) == 1
    joins = np.zeros(len(h), bool)
    joins[:-1] = ~right[:-1] & right[1:] & inner[:-1]
    joined = np.zeros(len(h), bool)
    joined[1:] = joins[:-1]
    previous = np.zeros(len(h), bool)
    previous[1:] = inner[:-1]
    new_lo = np.where(right, np.where(previous, np.roll(lo, 1), before[d]), lo)
    new_hi = np.where(right, hi, np.where(inner, np.roll(hi, -1), after[d]))
    i = np.flatnonzero(~joined)
    pair = joins[i]
    j = np.minimum(i + 1, len(h) - 1)
    return (
        np.where(pair, bytewords.mix(h[i] * _LEFT + h[j] * _RIGHT), h[i]), d[i],
        np.where(pair, lo[i], new_lo[i]), np.where(pair, hi[j], new_hi[i]),
    )


def _range_least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b]) for many non-empty ranges."""
    size = b - a
    power = np.frexp(size.astype(np.float64))[1] - 1
    out, level = np.zeros(len(a), x.dtype), x
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            step = 1 << (k - 1)
            level = np.minimum(level[:-step], level[step:])
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(level[a[own]], level[b[own] - (1 << k)])
    return out


def file_windows(block: bytewords.Block, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, key) of every window of ``span`` words in a block of documents."""
    first, last = block.first[:-1], block.first[1:]
    counts = np.maximum(last - first - span + 1, 0)
    window = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    document = np.repeat(np.arange(len(first)), counts)
    key = np.zeros(len(window), np.uint64)
    if not len(window):
        return document, window, key
    long = np.flatnonzero(counts)  # the rest has no windows
    n = len(block.hashes)
    up, down = bytewords._power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(block.hashes * up[:n], out=sums[1:])
    word = np.concatenate([np.arange(first[i], last[i]) for i in long])
    doc = np.repeat(long, (last - first)[long])
    h, low, high = block.hashes[word], word, word + 1
    levels = []
    for r in range(ROUNDS + 1):
        fits = high - low <= span
        if not fits.any():
            break
        name = bytewords.mix((sums[np.minimum(high, n)] - sums[np.maximum(low, 0)]) * down[np.maximum(low, 0)] + h * _OTHER + np.uint64(r))
        levels.append((low, high, name))
        if r < ROUNDS:
            h, doc, low, high = _round(h, doc, low, high, first - 1, last + 1, 2 * r + 1)
    left = np.arange(len(window))
    for low, high, name in reversed(levels):
        a, b = np.searchsorted(low, window[left]), np.searchsorted(high, window[left] + span, "right")
        has = a < b
        key[left[has]] = _range_least(name, a[has], b[has])
        left = left[~has]
        if not len(left):
            break
    return document, window, key


def _window_hashes(block: bytewords.Block, window: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(block.hashes)
    up, down = bytewords._power(n + 1)
    out = []
    for x in (block.hashes, block.second()):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=sums[1:])
        out.append(bytewords.mix((sums[window + span] - sums[window]) * down[window]).astype(np.int64))
    return out[0], out[1]


def _digest(block: bytewords.Block, i: int, clash: frozenset[int] = frozenset()) -> int:
    """A hash of a document's whole word sequence; ``clash`` holds hashes that several sequences share, which get another one."""
    own = block.hashes[block.first[i] : block.first[i + 1]]
    up, _ = bytewords._power(len(own) + 1)
    name = int((bytewords.mix(own * _OTHER + up[: len(own)] * _LEFT).sum(dtype=np.uint64) + np.uint64(len(own))).astype(np.int64))
    if name in clash:
        name = int.from_bytes(hashlib.sha256(_joined(block, i)).digest()[:8], "little", signed=True)
    return name


def _joined(block: bytewords.Block, i: int) -> bytes:
    """A document's words, joined by one blank."""
    return b" ".join(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split())


def _overview(docs: DataFrame, clash: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, n_words, text_class, whole_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sha = [], [], []
            for _, block in bytewords.blocks(batch.column(1), lower=False):
                for i in range(len(block.first) - 1):
                    n.append(int(block.first[i + 1] - block.first[i]))
                    digest.append(_digest(block, i, clash))
                    sha.append(hashlib.sha256(_joined(block, i)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "text_class", "whole_sha256"])

    return common.materialize(docs.mapInArrow(run, "doc_id long, n_words long, text_class long, whole_sha256 string"), "overview")


def _classes(overview: DataFrame) -> DataFrame:
    """One row per class of texts: the smallest id, the number of rows, and the range of its SHA-256."""
    rows = overview.groupBy("text_class").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("copies"), F.min("whole_sha256").alias("low"), F.max("whole_sha256").alias("high"))
    return common.materialize(rows, "text-classes")


def _key_rows(docs: DataFrame, span: int, clash: frozenset[int]) -> DataFrame:
    """(key, text_class, known): the keys of each class's windows, once for each task that meets it, so copies add little.

    known: null for rows that must be compared with those of other tasks. A key
    that several classes of one stretch of rows have is shared: two of them are left
    to compare, the others are known to share it (and have their class there).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, block in bytewords.blocks(batch.column(0), lower=False):
                document, _, key = file_windows(block, span)
                # Neighbouring windows mostly share their key.
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (document[1:] != document[:-1])
                names, fresh = np.zeros(len(block.first), np.int64), np.zeros(len(block.first), bool)
                for i in np.unique(document).tolist():
                    names[i] = _digest(block, i, clash)
                    fresh[i] = int(names[i]) not in met
                    met.add(int(names[i]))
                new &= fresh[document]
                held.append((key[new].astype(np.int64), names[document[new]]))
                if sum(len(k) for k, _ in held) > STRETCH:
                    yield _compared(held)
                    held = []
        if held:
            yield _compared(held)

    return docs.select("text").mapInArrow(run, "key long, text_class long, known long")


def _compared(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The distinct (key, class) of a stretch; ``known`` is the class where two other classes of the stretch stand for it."""
    key, name = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name = key[once], name[once]
    inner = np.zeros(len(key), bool)
    inner[1:-1] = (key[1:-1] == key[:-2]) & (key[1:-1] == key[2:])
    # Rows of a class stand together, which the shuffle's compression makes use of.
    back = np.argsort(name, kind="stable")
    key, name, inner = key[back], name[back], inner[back]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(name, mask=~inner)], ["key", "text_class", "known"])


def _shared(rows: DataFrame) -> DataFrame:
    """(text_class, shared): the keys of each class that another class has too.

    In the order of classes, each class of a shared key has another one beside it:
    one shuffle finds them, without a table of shared keys to join back.
    """
    beside = Window.partitionBy("key", "known").orderBy("text_class")
    other = lambda c: F.coalesce(c.over(beside) != F.col("text_class"), F.lit(False))
    rows = rows.withColumns({"before": other(F.lag("text_class")), "after": other(F.lead("text_class"))})
    rows = rows.filter(F.col("known").isNotNull() | F.col("before") | F.col("after"))
    return rows.groupBy("text_class").agg(F.collect_set("key").alias("shared"))


def _candidate_windows(texts: DataFrame, span: int) -> DataFrame:
    """(a, b, doc_id, text_class, at): hashes and places of the windows filed under shared keys.

    A window that an earlier document of the same stretch of rows holds is known to
    be a repeat: b is null, and a is its class, as its hashes aren't needed any more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, classes, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for at, block in bytewords.blocks(batch.column(2), lower=False):
                document, window, key = file_windows(block, span)
                signed, keep = key.astype(np.int64), np.zeros(len(key), bool)
                cuts = np.searchsorted(document, np.arange(len(block.first)))
                for i in range(len(block.first) - 1):
                    own = slice(cuts[i], cuts[i + 1])
                    keep[own] = np.isin(signed[own], shared[at + i].values.to_numpy())
                document, window = document[keep], window[keep]
                held.append((*_window_hashes(block, window, span), ids[document + at], classes[document + at], (window - block.first[document]).astype(np.int32)))
                if sum(len(x[0]) for x in held) > STRETCH:
                    yield _marked(held)
                    held = []
        if held:
            yield _marked(held)

    return texts.select("doc_id", "text_class", "text", "shared").mapInArrow(run, "a long, b long, doc_id long, text_class long, at int")


def _marked(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The windows of a stretch, those of which an earlier document is in it without their hashes."""
    a, b, doc, name, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((doc, b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    earliest = np.zeros_like(doc)
    earliest[order] = doc[order][fresh][np.cumsum(fresh) - 1]
    known = doc > earliest
    return pa.RecordBatch.from_arrays([pa.array(np.where(known, name, a)), pa.array(b, mask=known), pa.array(doc), pa.array(name), pa.array(at)], ["a", "b", "doc_id", "text_class", "at"])


def _starts(found: DataFrame) -> DataFrame:
    """(doc_id, text_class, starts): where windows begin that a document with a smaller id holds."""
    first = F.min("doc_id").over(Window.partitionBy("a", "b").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("first", first).filter(F.col("b").isNull() | (F.col("doc_id") > F.col("first")))
    return rows.groupBy("doc_id", "text_class").agg(F.collect_list("at").alias("starts"))


def _cut(texts: DataFrame, span: int) -> DataFrame:
    """(doc_id, text_class, n_removed, kept): what is left of each text without the words of the windows that begin at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(cover, at, 1)
                np.add.at(cover, at + span, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text_class", "n_removed", "kept"])

    return texts.select("doc_id", "text_class", "text", "starts").mapInArrow(run, "doc_id long, text_class long, n_removed long, kept string")


def repeats(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overview, classes, changed): every document's word count and class, the classes, and the cut texts of those that lose words.

    A document whose whole word sequence stands in one with a smaller id loses
    all its words if it has ``span`` of them at least; of such copies the first
    alone takes part in the search. Null ids and null texts: the document is left
    as it is and removes nothing. Rows with equal ids don't shorten one another.
    Texts are read whole. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    overview, clash = _overview(docs), frozenset()
    classes = _classes(overview)
    # Different texts under one 64-bit name, a handful in 10^10 texts: named anew.
    if same := [r.text_class for r in classes.filter("low <> high").select("text_class").collect()]:
        clash = frozenset(same)
        overview = _overview(docs, clash)
        classes = _classes(overview)
    shared = common.materialize(_shared(_key_rows(docs.filter(F.col("doc_id").isNotNull()), span, clash)), "shared")
    firsts = common.materialize(classes.select("text_class", F.col("first").alias("doc_id")).join(shared, "text_class"), "firsts")
    # Equal ids with other texts are told apart by the class of the text.
    wanted = common.materialize(firsts.select("doc_id").distinct(), "wanted")
    ids = docs.join(common.maybe_broadcast(wanted), "doc_id", "left_semi")
    texts = common.materialize(_with_class(ids, clash).join(firsts, ["doc_id", "text_class"]).dropDuplicates(["doc_id", "text_class"]), "texts")
    starts = _starts(_candidate_windows(texts, span))
    changed = _cut(texts.join(starts, ["doc_id", "text_class"]), span)
    return overview, classes, common.materialize(changed, "changed")


def _with_class(docs: DataFrame, clash: frozenset[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = [_digest(block, i, clash) for _, block in bytewords.blocks(batch.column(1), lower=False) for i in range(len(block.first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.int64())], ["doc_id", "text", "text_class"])

    return docs.mapInArrow(run, "doc_id long, text string, text_class long")


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one blank); see ``repeats``."""
    overview, classes, changed = repeats(docs, span)
    changed = common.materialize(changed.select("doc_id", "text_class", "n_removed", common.sha256_hex(F.col("kept")).alias("kept_sha256")), "cut")
    copies = common.materialize(classes.filter("copies > 1").select("text_class", "first"), "copies")
    out = overview.join(common.maybe_broadcast(copies), "text_class", "left").join(common.maybe_broadcast(changed), ["doc_id", "text_class"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= span), F.lit(False))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.when(copy, common.sha256_hex(F.lit(""))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))
