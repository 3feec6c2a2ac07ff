"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a learned embedding of the word, the mean of the learned
embeddings of its character n-grams, and beside them four numbers from tables
fitted on the training rows: how much likelier the word, and the n-grams within
it, are in documents labelled toxic. The network reads windows of words in both
directions, pools them by attention, and a document's logit is that of its most
toxic window. Training sees a bounded, documented sample of labelled rows, in
one task; every window of every whole text is scored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import bytewords, common

#: Labelled rows of either class that training takes at most, chosen by hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: A window begins at every STRIDE-th word, so any WINDOW - STRIDE + 1 words lie whole in one; training looks for its windows in wider steps.
WINDOW, STRIDE, TRAIN_STRIDE = 64, 16, 48
#: DIM: numbers of a learned embedding of a word and of a character n-gram; ODDS: of the fitted tables.
HIDDEN, ATTENTION, DIM, ODDS = 8, 8, 4, 4
INPUTS = ODDS + 2 * DIM
#: Passes over the sample: EPOCHS, or as many as make STEPS steps.
EPOCHS, STEPS, BATCH, RATE = 8, 160, 128, 0.02
#: The embeddings' step and decay, and the share of windows that see them in training: without them a small sample is learned by heart.
EMBED_RATE, DECAY, KEPT = 2.0, 1e-3, 0.5
FOLDS = 4
#: log2 of the rows of the fitted tables and of the embeddings; n-grams of so many bytes.
BITS, EMBED_BITS = 18, 14
GRAMS = (3, 4, 5, 6)
SMOOTH = 2.0
#: Distinct words whose inputs a scoring task remembers.
CACHE = 150_000


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# --- features -----------------------------------------------------------------


@dataclass
class Words:
    """Distinct words: their hashes and table rows; the rows of word i's character n-grams are grams[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    row: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def _described(block: bytewords.Block, at: np.ndarray) -> Words:
    """The words at positions ``at`` of a block."""
    shift = np.uint64(64 - BITS)
    row = (block.hashes[at] >> shift).astype(np.int64)
    starts, lengths = block.starts[at], block.ends[at] - block.starts[at]
    # The words' bytes, each between two border marks.
    size = lengths + 2
    first = np.cumsum(size) - size
    data = np.full(int(size.sum()), 1, np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data[np.repeat(first + 1, lengths) + place] = bytewords._LOWER[block.data[np.repeat(starts, lengths) + place]]
    up, down = bytewords._power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(bytewords._BYTE[data] * up[: len(data)], out=sums[1:])
    rows, owners = [], []
    for n in GRAMS:
        counts = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(size)), counts)
        begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows.append((bytewords.mix((sums[begin + n] - sums[begin]) * down[begin]) >> shift).astype(np.int64))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return Words(block.hashes[at], row, np.concatenate(rows)[order], np.searchsorted(owner[order], np.arange(len(size) + 1)))


def _chosen(words: Words, at: np.ndarray) -> Words:
    """The words at places ``at`` of a list of words."""
    counts = (words.first[1:] - words.first[:-1])[at]
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.repeat(words.first[:-1][at] - first[:-1], counts) + np.arange(first[-1])
    return Words(words.hashes[at], words.row[at], words.grams[place], first)


def _odds_inputs(words: Words, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """ODDS numbers of each word: log odds, whether it is known, largest and mean log odds of its n-grams."""
    out = np.zeros((len(words.row), ODDS), np.float32)
    out[:, 0] = word_odds[words.row]
    out[:, 1] = word_odds[words.row] != 0
    if len(words.grams):
        has = words.first[1:] > words.first[:-1]
        value = gram_odds[words.grams]
        at = words.first[:-1][has]
        out[has, 2] = np.maximum.reduceat(value, at)
        out[has, 3] = np.add.reduceat(value, at) / (words.first[1:] - words.first[:-1])[has]
    return out


def _embedded(p: dict, words: Words) -> np.ndarray:
    """2 * DIM numbers of each word: its embedding, and the mean embedding of its n-grams."""
    shift = BITS - EMBED_BITS
    out = np.zeros((len(words.row), 2 * DIM), p["words"].dtype)
    out[:, :DIM] = p["words"][words.row >> shift]
    if len(words.grams):
        has = words.first[1:] > words.first[:-1]
        out[has, DIM:] = np.add.reduceat(p["grams"][words.grams >> shift], words.first[:-1][has]) / (words.first[1:] - words.first[:-1])[has, None]
    return out


def _embedded_back(p: dict, words: Words, slope: np.ndarray) -> dict[str, np.ndarray]:
    """The slopes of both embedding tables from those of ``_embedded``'s numbers."""
    shift, counts = BITS - EMBED_BITS, words.first[1:] - words.first[:-1]
    shared = slope[:, DIM:] / np.maximum(counts, 1)[:, None]
    return {
        "words": _summed(words.row >> shift, slope[:, :DIM], 1 << EMBED_BITS).astype(slope.dtype),
        "grams": _summed(words.grams >> shift, np.repeat(shared, counts, 0), 1 << EMBED_BITS).astype(slope.dtype),
    }


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of those of ``rows`` that ``at`` sends there."""
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1)


def _log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    t, c = max(1.0, toxic.sum()), max(1.0, clean.sum())
    share = t / (t + c)
    return (np.log((toxic + SMOOTH * share) / t) - np.log((clean + SMOOTH * (1 - share)) / c)).astype(np.float32)


# --- network ------------------------------------------------------------------


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.4, (INPUTS, 3 * HIDDEN))
        p[f"{d}h"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p[f"{d}b"] = np.zeros(3 * HIDDEN)
    p |= {"a": rng.normal(0, 0.4, (2 * HIDDEN, ATTENTION)), "ab": np.zeros(ATTENTION), "v": rng.normal(0, 0.5, ATTENTION), "w": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
    p |= {k: rng.normal(0, 0.02, (1 << EMBED_BITS, DIM)) for k in ("words", "grams")}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _projected(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What inputs x (..., INPUTS) add to the gates of either direction."""
    return x @ p["fx"] + p["fb"], x @ p["bx"] + p["bb"]


def _forward(p: dict, inputs: tuple[np.ndarray, np.ndarray], place: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows. inputs: ``_projected`` rows; place: which of them stands where (time, windows). keep: what backward needs as well."""
    steps, n = mask.shape
    hidden = np.zeros((steps, n, 2 * HIDDEN), inputs[0].dtype)
    saved = {}
    for k, d in enumerate("fb"):
        h = np.zeros((n, HIDDEN), inputs[k].dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            u = h @ p[f"{d}h"]
            own = inputs[k][place[t]]
            gates = own[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(own[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            z = z * mask[t][:, None]
            if keep:
                saved[d, t] = (h, z, r, c, u[:, 2 * HIDDEN :])
            h = h + z * (c - h)
            hidden[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
    u = np.tanh(hidden.reshape(-1, 2 * HIDDEN) @ p["a"] + p["ab"]).reshape(steps, n, ATTENTION)
    e = np.exp(np.clip(u @ p["v"], -30, 30)) * mask
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = np.einsum("tnh,tn->nh", hidden, alpha)
    logit = pooled @ p["w"] + p["c"]
    return (logit, hidden, u, alpha, pooled, saved) if keep else (logit,)


def _backward(p: dict, x: np.ndarray, state: tuple, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The slopes of the network's weights, and those of its inputs x."""
    _, hidden, u, alpha, pooled, saved = state
    steps, n, _ = x.shape
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams")}
    g["w"], g["c"] = pooled.T @ slope, np.array([slope.sum()], slope.dtype)
    d_pooled = slope[:, None] * p["w"]
    d_hidden = alpha[:, :, None] * d_pooled
    d_alpha = (hidden * d_pooled).sum(2)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    d_u = d_e[:, :, None] * p["v"] * (1 - u**2)
    g["v"] = (d_e[:, :, None] * u).sum((0, 1))
    g["a"] = hidden.reshape(-1, 2 * HIDDEN).T @ d_u.reshape(-1, ATTENTION)
    g["ab"] = d_u.sum((0, 1))
    d_hidden = d_hidden + d_u @ p["a"].T
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        back = np.zeros((n, HIDDEN), x.dtype)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, z, r, c, uc = saved[d, t]
            back = back + d_hidden[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_c = back * z * (1 - c**2)
            d_z = back * (c - h) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            own = np.concatenate([d_z, d_r, d_c], 1)
            through = np.concatenate([d_z, d_r, d_c * r], 1)
            g[f"{d}x"] += x[t].T @ own
            g[f"{d}b"] += own.sum(0)
            g[f"{d}h"] += h.T @ through
            d_x[t] += own @ p[f"{d}x"].T
            back = back * (1 - z) + through @ p[f"{d}h"].T
    return g, d_x


def _windows(first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of the overlapping windows; an empty document has one empty window."""
    n = first[1:] - first[:-1]
    count = np.maximum(1, -(-(n - WINDOW) // stride) + 1)
    document = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return document, first[:-1][document] + at, np.minimum(WINDOW, n[document] - at)


def _places(which: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which word stands at each place of windows, time first, and their mask."""
    t = np.arange(min(WINDOW, max(1, int(length.max(initial=1)))))[:, None]
    mask = t < length
    return which[np.where(mask, at + t, 0)] if len(which) else np.zeros(mask.shape, np.int64), mask.astype(np.float32)


def _logits(p: dict, gates: tuple[np.ndarray, np.ndarray], which: np.ndarray, at: np.ndarray, length: np.ndarray, most: int = 1024) -> np.ndarray:
    """Logits of windows; gates: ``_projected`` inputs of each distinct word, which: the distinct word at each position."""
    out = np.zeros(len(at), np.float32)
    for i in range(0, len(at), most):
        place, mask = _places(which, at[i : i + most], length[i : i + most])
        out[i : i + most] = _forward(p, gates, place, mask)[0]
    return out


# --- training -----------------------------------------------------------------


@dataclass
class Model:
    """Fitted tables, network and the two numbers that turn a document's logit into a probability."""

    word_odds: np.ndarray
    gram_odds: np.ndarray
    network: dict[str, np.ndarray]
    scale: float
    shift: float

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, word_odds=self.word_odds, gram_odds=self.gram_odds, fit=np.array([self.scale, self.shift]), **{f"net_{k}": v for k, v in self.network.items()})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return Model(held["word_odds"], held["gram_odds"], {k[4:]: held[k] for k in held.files if k.startswith("net_")}, *map(float, held["fit"]))

    def inputs(self, words: Words) -> np.ndarray:
        return np.hstack([_odds_inputs(words, self.word_odds, self.gram_odds), _embedded(self.network, words)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        return Scorer(self).scores(texts)


class Scorer:
    """A model with the projected inputs of the words that it has met, at most CACHE and those of one block."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.gates = tuple(np.zeros((0, 3 * HIDDEN), np.float32) for _ in range(2))

    def _which(self, block: bytewords.Block) -> np.ndarray:
        """The row of ``gates`` of each word of a block."""
        if len(self.hashes) > CACHE:
            self._forget()
        known = np.searchsorted(self.hashes, block.hashes)
        new = np.append(self.hashes, np.uint64(0))[known] != block.hashes
        new[known == len(self.hashes)] = True
        if new.any():
            at = np.flatnonzero(new)
            words = _described(block, at[np.unique(block.hashes[at], return_index=True)[1]])
            gates = _projected(self.model.network, self.model.inputs(words))
            self.order = np.concatenate([self.order, len(self.gates[0]) + np.arange(len(words.row))])
            self.gates = tuple(np.concatenate([a, b]) for a, b in zip(self.gates, gates, strict=True))
            self.hashes = np.concatenate([self.hashes, words.hashes])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.order = self.hashes[order], self.order[order]
            known = np.searchsorted(self.hashes, block.hashes)
        return self.order[known]

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for base, block in bytewords.blocks(texts, lower=True):
            which = self._which(block)
            gates = self.gates if len(self.gates[0]) else tuple(np.zeros((1, 3 * HIDDEN), np.float32) for _ in range(2))
            document, at, length = _windows(block.first)
            top = np.full(len(block.first) - 1, -np.inf)
            np.maximum.at(top, document, _logits(self.model.network, gates, which, at, length))
            out[base : base + len(top)] = _sigmoid(self.model.scale * top + self.model.shift)
        return out


def _sample_words(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """(distinct words, which of them stands at each position, first position of each text), a block at a time."""
    parts, which, first, offset = [], [], [np.zeros(1, np.int64)], 0
    for _, block in bytewords.blocks(pa.array(texts, pa.string()), lower=True):
        _, at, inverse = np.unique(block.hashes, return_index=True, return_inverse=True)
        which.append(inverse.astype(np.int64) + sum(len(w.row) for w in parts))
        parts.append(_described(block, at))
        first.append(block.first[1:] + offset)
        offset += len(inverse)
    counts = np.concatenate([np.diff(w.first) for w in parts])
    every = Words(np.concatenate([w.hashes for w in parts]), np.concatenate([w.row for w in parts]), np.concatenate([w.grams for w in parts]), np.concatenate([[0], np.cumsum(counts)]))
    _, at, inverse = np.unique(every.hashes, return_index=True, return_inverse=True)
    return _chosen(every, at), inverse[np.concatenate(which)], np.concatenate(first)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model | None:
    """Fit on texts and 0/1 labels; weights: how many labelled rows each stands for. None unless both labels occur.

    A training document's table numbers come from the other folds, so that its
    own rare words don't give it away. Some texts without words join the sample
    as clean ones; few tables have any.
    """
    if len(set(labels.tolist())) < 2:
        return None
    blank = max(8, len(texts) // 32)
    texts, labels, weights = [*texts, *[""] * blank], np.append(labels, [0] * blank), np.append(weights, [0.0] * blank)
    rng = np.random.default_rng(seed)
    fold = np.arange(len(texts)) % FOLDS
    size = 1 << BITS
    words, which, first = _sample_words(texts)
    n = len(words.row)
    document = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = np.unique(document * max(1, n) + which)
    own_doc, own_word = pairs // max(1, n), pairs % max(1, n)
    word_counts, gram_counts = np.zeros((FOLDS, 2, size), np.float32), np.zeros((FOLDS, 2, size), np.float32)
    for f in range(FOLDS):
        for y in (0, 1):
            held = np.bincount(own_word[(fold[own_doc] == f) & (labels[own_doc] == y)], minlength=n).astype(np.float32)
            np.add.at(word_counts[f, y], words.row, held)
            np.add.at(gram_counts[f, y], words.grams, np.repeat(held, np.diff(words.first)))
    del document, pairs, own_doc, own_word
    odds = lambda c: _log_odds(c[1], c[0])
    by_fold = np.stack([_odds_inputs(words, odds(word_counts.sum(0) - word_counts[f]), odds(gram_counts.sum(0) - gram_counts[f])) for f in range(FOLDS)])
    if not n:
        by_fold, words = np.zeros((FOLDS, 1, ODDS), np.float32), Words(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(2, np.int64))
    network = _start(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.items()}

    def values(stride: int) -> tuple:
        """Windows of all texts and their logits, each text with its fold's tables."""
        owner, at, length = _windows(first, stride)
        out, embedded = np.zeros(len(at), np.float32), _embedded(network, words)
        for f in range(FOLDS):
            mine = np.flatnonzero(fold[owner] == f)
            out[mine] = _logits(network, _projected(network, np.hstack([by_fold[f], embedded])), which, at[mine], length[mine])
        return owner, at, length, out

    def tops(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, owner))
        return order[np.searchsorted(owner[order], np.arange(len(texts)), "right") - 1]

    # The first windows are those of the largest odds; later ones the network chooses.
    owner, at, length = _windows(first, TRAIN_STRIDE)
    worth = np.maximum(by_fold[..., 0], 0) + np.maximum(by_fold[..., 2], 0)
    running = np.concatenate([[0], np.cumsum(worth[np.repeat(fold, np.diff(first)), which])]) if len(which) else np.zeros(1)
    value, step = running[at + length] - running[at], 0
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    batches = max(1, len(texts) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        decay = 0.05 ** (epoch / epochs)
        chosen = tops(owner, value)
        for batch in np.array_split(rng.permutation(len(texts)), batches):
            place, mask = _places(which, at[chosen[batch]], length[chosen[batch]])
            met, back = np.unique(place, return_inverse=True)
            seen = _chosen(words, met)
            some = (rng.random((1, len(batch), 1)) < KEPT) / np.float32(KEPT)
            x = np.concatenate([by_fold[np.broadcast_to(fold[batch], place.shape), place], _embedded(network, seen)[back.reshape(place.shape)] * some.astype(np.float32)], 2)
            state = _forward(network, _projected(network, x.reshape(-1, INPUTS)), np.arange(place.size).reshape(place.shape), mask, keep=True)
            slope = ((_sigmoid(state[0]) - labels[batch]) * balance[batch] / len(batch)).astype(np.float32)
            gradient, d_x = _backward(network, x, state, slope)
            d_embedded = _summed(back.ravel(), (d_x[:, :, ODDS:] * some).reshape(-1, 2 * DIM), len(met)).astype(np.float32)
            step += 1
            for k, g in _embedded_back(network, seen, d_embedded).items():
                network[k] -= EMBED_RATE * decay * (g + DECAY * network[k])
            for k, g in gradient.items():
                m, v = moments[k]
                m += 0.1 * (np.clip(g, -1, 1) - m)
                v += 0.01 * (np.clip(g, -1, 1) ** 2 - v)
                network[k] = (network[k] - RATE * decay * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if epoch in (epochs // 8, epochs // 2):
            value = values(TRAIN_STRIDE)[3]
    # Probabilities as among all labelled rows: a weighted logistic fit of label on logit, by Newton's method.
    owner, _, _, value = values(STRIDE)
    z = np.column_stack([value[tops(owner, value)], np.ones(len(texts))]).astype(np.float64)
    fit = np.array([1.0, 0.0])
    for _ in range(25):
        q = _sigmoid(z @ fit)
        slope = z.T @ (weights * (q - labels)) + 1e-3 * fit
        curve = (z * (weights * q * (1 - q))[:, None]).T @ z + 1e-3 * np.eye(2)
        fit = fit - np.clip(np.linalg.solve(curve, slope), -2, 2)
    every = word_counts.sum(0), gram_counts.sum(0)
    return Model(odds(every[0]), odds(every[1]), network, float(max(fit[0], 1e-3)), float(fit[1]))


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (model binary), trained in one task on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows outside the held-out fifth, chosen by hash.

    No row where the labels outside the held-out fifth are not of both classes.
    The model is a table in the shared folder; its size doesn't depend on the data.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    picked = marks.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    picked = picked.filter("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE_TOXIC).unionByName(picked.filter("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE_CLEAN))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[1], r[2]))
        truth = np.array([r[0] for r in rows], np.int64)
        share = {y: counts.get(y, 0) / max(1, int((truth == y).sum())) for y in (0, 1)}
        texts = [r[3] for r in rows]
        del rows
        model = train(texts, truth, np.array([share[int(y)] for y in truth]))
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])

    return common.materialize(rows.select("toxic", "h", "doc_id", "text").repartition(1).mapInArrow(run, "model binary"), "toxicity-model")


def _scored(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(row, score): each row of docs untouched, and its score."""
    spark = docs.sparkSession
    held = [bytes(r.model) for r in model.collect()]
    sent = spark.sparkContext.broadcast(held[0] if held else None)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model.from_bytes(sent.value)) if sent.value else None
        for batch in batches:
            values = scorer.scores(batch.column(0).field(at)) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["row", "score"])

    return packed.mapInArrow(run, schema)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to docs; both replace columns of those names.

    A null or empty text has one empty window. Without a model (no labels of
    either class to learn from) every score is 0. Repeated rows score alike; null
    ids don't matter. Whole texts are scored, however long.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return _scored(docs.select(*[F.col(f"`{c}`") for c in kept]), model).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out (a null id is), score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns, whatever their names."""
    return _scored(docs, fit(docs, labels)).filter(F.col("score") < 0.5).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
