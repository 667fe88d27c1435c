"""Hashed word and character n-gram features of whole texts, and sums of tables over them."""

from __future__ import annotations

import numpy as np

from .hashing import _ranges, blocks, mix

_STEP = np.uint64(0xD1342543DE82EF95)


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts with one blank before each and after the last; which are blank; where each text starts."""
    whole = "\n" + "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = (cp <= 32) | (cp == 0x85) | (cp == 0xA0) | (cp == 0x3000) | ((cp >= 0x2000) & (cp <= 0x200A))
    begins = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    return np.where(blank, np.uint64(32), cp), blank, begins


def gram_ids(texts: list[str | None], sizes: tuple[int, ...], bits: int, words: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, and last for whole words: (bucket of each feature in text order, offsets of the texts).

    An n-gram lies within a word and the blank on either side of it; a word is a run without blanks.
    """
    cp, blank, begins = _code_points(texts)
    m = mix(cp)
    inner = np.concatenate([[0], np.cumsum(blank)])
    out, h, have = [], m, 1
    for n in sorted(sizes):
        while have < n:
            h = h[:-1] * _STEP + m[have:]
            have += 1
        at = np.arange(len(h))
        keep = np.flatnonzero(inner[at + n - 1] - inner[at + 1] == 0) if n > 2 else at
        ids = (mix(h[keep] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
        out.append((ids, np.searchsorted(keep, begins)))
    if words:
        edge = np.diff(blank.astype(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        ids = (mix(_ranges(m, start, end)) >> np.uint64(64 - bits)).astype(np.int64)
        out.append((ids, np.searchsorted(start, begins)))
    return out


def segment_sums(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sums of values[offset[i]:offset[i+1]]; 0 for an empty range."""
    out = np.zeros((len(offset) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(offset))
    if len(full):
        out[full] = np.add.reduceat(values[: offset[-1]], offset[full], axis=0)
    return out


#: Columns of a table that are looked up at once, which bounds what a block of texts takes.
COLUMNS = 8


def mean_scores(texts: list[str | None], table: np.ndarray, sizes: tuple[int, ...], bits: int, words: bool = True) -> np.ndarray:
    """The mean over all features of each text of the rows of `table`; zeros where a text has none."""
    parts = []
    for lo, hi in blocks(texts):
        total, count = np.zeros((hi - lo, *table.shape[1:])), 0
        for ids, offset in gram_ids(texts[lo:hi], sizes, bits, words):
            if table.ndim == 1:
                total += segment_sums(table[ids], offset)
            else:
                for c in range(0, table.shape[1], COLUMNS):
                    total[:, c : c + COLUMNS] += segment_sums(table[ids, c : c + COLUMNS], offset)
            count = count + np.diff(offset)
        parts.append(total / np.maximum(count, 1).reshape(-1, *[1] * (table.ndim - 1)))
    return np.concatenate(parts) if parts else np.zeros((0, *table.shape[1:]))


def bags(texts: list[str | None], sizes: tuple[int, ...], bits: int, words: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct feature buckets and their shares, for training."""
    out = []
    for t in texts:
        ids = np.concatenate([i for i, _ in gram_ids([t], sizes, bits, words)])
        own, n = np.unique(ids, return_counts=True)
        out.append((own, (n / max(n.sum(), 1)).astype(np.float32)))
    return out
