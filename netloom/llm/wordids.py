"""Token ids of whole texts, put together with numpy from remembered ids of their words.

Two kinds of tokenizers are served. One drops white space, takes lower case and
marks the end of a word; the other is byte-level and takes a blank with the word
behind it. Both cut a text between an ASCII letter and an ASCII sign other than an
apostrophe, so a text's ids are those of its words and of the signs around them.
Words are known by 64-bit hashes; among a million of them two have the same one
with a probability of about 10^-7. Texts in which a special token stands, or a
blank of a byte-level tokenizer next to other white space or at an end, go through
the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from netloom.llm import bytewords

#: Words that a Python worker remembers; beyond it, it begins anew. Letters-only ones reach the library so many at a time.
CACHE, JOINED = 1_000_000, 1000
_ALONE = np.uint64(0x5851F42D4C957F2D)
#: Latin letters that no normal form changes.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ɏ]+").fullmatch
_BYTE = np.arange(256)
_SPACE = _BYTE == 32
_LETTER = np.isin(_BYTE, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_SIGN = np.isin(_BYTE, list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'))


class TextIds:
    """Ids of whole texts by the tokenizer in a file, byte-level or by words."""

    def __init__(self, path: str, byte_level: bool, dtype: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.byte_level, self.cache = Tokenizer.from_file(path), byte_level, cache
        self.dtype = np.dtype(dtype or ("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Which ids begin a word that has a blank before it, or end a word.
        self.mark = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.mark[i] = token.startswith("Ġ") if byte_level else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[list[int]]:
        """The ids of letters-only words, each behind a blank: many in one text, which is cut at the marks."""
        out: list[list[int]] = []
        for low in range(0, len(words), JOINED):
            some = words[low : low + JOINED]
            ids = self._alone([" " + " ".join(some)])[0]
            marks = np.flatnonzero(self.mark[ids]).tolist()
            cuts = [*marks, len(ids)] if self.byte_level else [0, *(m + 1 for m in marks)]
            if len(cuts) != len(some) + 1 or cuts[0] or cuts[-1] != len(ids):
                out += self._alone([" " + w for w in some])
            else:
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, words: list[str], joins: list[bool]) -> list[list[int] | None]:
        """The ids of words, behind a blank where ``joins`` says so; None where a byte-level blank would meet other white space."""
        out: list[list[int] | None] = [None] * len(words)
        letters, rest = [], []
        for i, (w, join) in enumerate(zip(words, joins, strict=True)):
            if join and _LETTERS(w):
                letters.append(i)
            elif not self.byte_level or not (w[-1].isspace() or (join and w[0].isspace())):
                rest.append(i)
        for places, ids in ((letters, self._joined([words[i] for i in letters])), (rest, self._alone([" " + words[i] if joins[i] else words[i] for i in rest]))):
            for i, own in zip(places, ids, strict=True):
                out[i] = own
        return out

    def _take_in(self, hashes: np.ndarray, words: list[str], joins: list[bool]) -> None:
        """New words, in the order of their hashes."""
        found = self._learn(words, joins)
        size = np.array([-1 if x is None else len(x) for x in found], np.int64)
        held = np.maximum(size, 0)
        flat = np.array([i for x in found if x for i in x], self.dtype)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.dtype)])
        at = self.used + np.cumsum(held) - held
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _block(self, block: bytewords.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, plain): the ids of a block's documents, document i's at first[i]:first[i + 1], where plain[i]."""
        if len(self.hashes) > self.cache:
            self._forget()
        n = len(block.first) - 1
        plain, joins, hashes = np.ones(n, bool), np.ones(len(block.hashes), bool), block.hashes
        data = block.data.tobytes()
        for x in self.special:
            at = data.find(x)
            while at >= 0:
                plain[np.searchsorted(block.offsets, at, "right") - 1] = False
                at = data.find(x, at + 1)
        if self.byte_level:
            blank = block.data == 32
            # One piece more than blanks: no blank stands at an end or next to another one.
            joins = (block.starts > 0) & blank[block.starts - 1]
            joins[block.first[:-1][np.diff(block.first) > 0]] = False
            pieces = np.concatenate([[0], np.cumsum(joins)])[block.first]
            blanks = np.concatenate([[0], np.cumsum(blank)])[block.offsets]
            plain &= (np.diff(block.first) > 0) & (np.diff(pieces) == np.diff(blanks)) & ~blank[np.minimum(block.offsets[:-1], max(0, len(blank) - 1))] if len(blank) else np.zeros(n, bool)
            hashes = np.where(joins, hashes, bytewords.mix(hashes ^ _ALONE))
        own, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, own)
        known = np.zeros(len(own), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == own[inside]
        if not known.all():
            new = index[~known]
            words = [data[a:b].decode() for a, b in zip(block.starts[new].tolist(), block.ends[new].tolist(), strict=True)]
            self._take_in(own[~known], words, joins[new].tolist())
            place = np.searchsorted(self.hashes, own)
        at, size = self.at[place][inverse], self.size[place][inverse]
        plain &= np.diff(np.concatenate([[0], np.cumsum(size < 0)])[block.first]) == 0
        held = np.maximum(size, 0)
        before = np.concatenate([[0], np.cumsum(held)])
        ids = self.pool[np.repeat(at - before[:-1], held) + np.arange(before[-1])] if before[-1] else np.zeros(0, self.dtype)
        return ids, before[block.first], plain

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null text has none."""
        blank = {"blank": _SPACE} if self.byte_level else {}
        for low, block in bytewords.blocks(texts, lower=not self.byte_level, cut=(_LETTER, _SIGN), **blank):
            ids, first, plain = self._block(block)
            rest = np.flatnonzero(~plain).tolist()
            whole = dict(zip(rest, self._alone([texts[low + i].as_py() or "" for i in rest]), strict=True))
            for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                yield np.array(whole[i], self.dtype) if i in whole else ids[a:b]


_known: dict[tuple[str, bool, str | None], TextIds] = {}


def text_ids(path: str, byte_level: bool, dtype: str | None = None) -> TextIds:
    """One of each kind for a Python worker: what it remembers serves later tasks too."""
    key = path, byte_level, dtype
    if key not in _known:
        _known[key] = TextIds(*key)
    return _known[key]
