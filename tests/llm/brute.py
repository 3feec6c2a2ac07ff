"""Plain, slow versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edited(rows: list[tuple[int, str | None]]) -> dict[int, str]:
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = t[: len(t) - half] + after[:half]
    return out


def sketch(text: str | None, size: int = 5, scale: int = 8) -> list[int]:
    """Hashes of the shingles below the fraction, or else the smallest one; xxHash64 of a shingle chains over its words."""
    import xxhash

    w = WORD.findall((text or "").lower())
    runs = [w[k : k + size] for k in range(len(w) - size + 1)] if len(w) >= size else [w] if w else []
    hashes = set()
    for run in runs:
        h = 42
        for x in run:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        hashes.add(h - 2**64 if h >= 2**63 else h)
    below = sorted(h for h in hashes if h < -(2**63) + 2**64 // scale)
    return below or sorted(hashes)[:1]


def likeness(a: list[int], b: list[int]) -> float:
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs: list[tuple[int, str | None]], n: int = 4, share: int = 85) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(docs: list[tuple[int, str | None]], span: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {i: WORD.findall(t or "") for i, t in docs}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                gone[k : k + span] = [True] * span
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out
