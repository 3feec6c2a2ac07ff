"""Words and word-run hashes of whole Arrow batches of texts, with numpy.

A batch is cut into blocks of about ``BLOCK`` bytes at document borders; a longer
document is a block of its own. Within a block all words of all documents are
found and hashed at once, so the cost is a few vector operations per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For a second hash of each word, from its bytes anew: other bytes, another step.
_BYTE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP_2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_INVERSE_2 = np.uint64(pow(int(_STEP_2), -1, 2**64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _raised(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a step."""
    if len(_powers.get(int(base), ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return _powers[int(base)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _raised(_STEP, n), _raised(_INVERSE, n)


class Block:
    """Words of a run of documents.

    data: their bytes; starts, ends: byte positions of words; hashes: one for each
    word; first: for document i, words first[i]:first[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool = True, blank: np.ndarray = _BLANK, cut: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~blank[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        borders = offsets[(offsets > 0) & (offsets < n)]
        begins[borders] = word[borders]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[borders - 1] = word[borders - 1]
        if cut and n:
            one, other = cut[0][data], cut[1][data]
            between = np.flatnonzero((one[:-1] & other[1:]) | (other[:-1] & one[1:]))
            ends[between], begins[between + 1] = True, True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashed:
            up, down = _power(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:n], out=sums[1:])
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def second(self) -> np.ndarray:
        """Another hash of each word of a block that isn't lower-cased, independent of the first."""
        n = len(self.data)
        up, down = _raised(_STEP_2, n + 1), _raised(_INVERSE_2, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_2[self.data] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def runs(self, k: int) -> np.ndarray:
        """The hash of each run of k words by its first word; runs that cross a document's end mean nothing."""
        if len(self.hashes) < k:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(self.hashes) - k + 1, np.uint64)
        for j in range(k):
            out += self.hashes[j : len(self.hashes) - k + 1 + j] * _PLACE[j]
        return mix(out)

    def whole(self, i: int) -> np.uint64:
        """The hash of a short document's whole word sequence."""
        own = self.hashes[self.first[i] : self.first[i + 1]]
        return mix(np.array([(own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]


def blocks(texts: pa.Array, lower: bool, hashed: bool = True, blank: np.ndarray = _BLANK, cut: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, Block]]:
    """(index of the first document, Block) over an Arrow string array; null texts are empty.

    blank: which bytes separate words. cut: two kinds of bytes; where one of either
    kind stands next to one of the other, a word ends and another begins.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, hashed, blank, cut)
        at = to
