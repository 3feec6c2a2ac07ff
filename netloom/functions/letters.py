"""How often letters stand in texts, counted in whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters whose shares tell the languages of the tables' texts apart.
LETTERS = "abcdefghijklmnopqrstuvwxyzéèêçàäöüßñóíáú"


#: A letter's place in LETTERS by its byte, and by the byte behind 0xC3 (all others of them are two bytes in UTF-8); the last place is for all else.
ONE_BYTE, BEHIND_C3 = np.full(256, len(LETTERS), np.uint8), np.full(256, len(LETTERS), np.uint8)
for _place, _letter in enumerate(LETTERS):
    (ONE_BYTE if _letter < "\x80" else BEHIND_C3)[_letter.encode()[-1]] = _place


def letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, text) to (lang, size, counts): how often each of LETTERS stands in a text, in one pass over its bytes."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + batch.num_rows + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        counts = np.zeros((batch.num_rows, len(LETTERS) + 1), np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for at in range(a, b, 1 << 20):  # a long text in pieces
                own = data[at : min(at + (1 << 20), b)]
                place = ONE_BYTE[own]
                behind = np.flatnonzero(data[max(at - 1, a) : at + len(own) - 1] == 0xC3) + (at == a)
                place[behind] = BEHIND_C3[own[behind]]
                counts[i] += np.bincount(place, minlength=len(LETTERS) + 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(LETTERS)), pa.array(counts[:, :-1].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["lang", "size", "counts"])
