"""Vectorised hashes of words, shingles and documents; all work on a list of whole texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Texts are handled in blocks of about so many bytes (a longer text is a block of its own).
BLOCK_BYTES = 500_000

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64; those of a block are kept, longer ones are not."""
    if len(_powers[0]) < n:
        found = []
        for b in (_BASE, _INVERSE):
            x = np.full(max(n, min(2 * n, 2 * BLOCK_BYTES)), b, np.uint64)
            x[0] = 1
            found.append(np.cumprod(x, dtype=np.uint64))
        if n > 2 * BLOCK_BYTES:
            return found[0], found[1]
        _powers[:] = found
    return _powers[0][:n], _powers[1][:n]


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A position-free hash of values[start:end] for each range."""
    p, inv = _pow(len(values) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * p[: len(values)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about BLOCK_BYTES each."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and the offsets at which each text's words begin and end."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return _ranges(_BYTES[data], start, end), np.searchsorted(start, begins)


def fingerprints(texts: list[str | None], word: np.ndarray, offset: np.ndarray) -> list[bytes]:
    """16 bytes for the sequence of words of each text; a text without words is told by its own bytes."""
    lo, hi = offset[:-1], offset[1:]
    both = np.stack([_ranges(word, lo, hi), _ranges(mix(word ^ _BASE), lo, hi)], axis=1)
    out = [r.tobytes() for r in both]
    for i in np.flatnonzero(lo == hi):
        out[i] = hashlib.blake2b((texts[i] or "").encode("utf-8", "surrogatepass"), digest_size=16, person=b"wordless").digest()
    return out


def shingle_cells(word: np.ndarray, offset: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of the weighted shingle sets: (text of each cell, its 64-bit hash), sorted by both.

    A shingle that occurs w times has weight w, which is w cells; so the weighted Jaccard
    similarity of two texts is the plain one of their cells. A text with fewer words than `width`
    has one shingle of them all; one without words has none.
    """
    n = np.diff(offset)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offset[:-1][text] + within
    value = _ranges(word, start, np.minimum(start + width, offset[1:][text]))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0)) if len(text) else np.zeros(0, np.int64)
    again = (np.arange(len(text)) - first).astype(np.uint64)
    return text, mix(value + again * np.uint64(0xD6E8FEB86659FD93))


def byte_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[start:end] for each range, wherever it lies."""
    return _ranges(_BYTES[data], start, end)
