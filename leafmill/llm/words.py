"""Hashes of words and word shingles of whole texts, computed on bytes.

A word is a run of characters between white space, in lower case. All functions
work on a batch of texts at once; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BATCH_CHARS = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _ROLL)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def slices(texts: Iterable[str | None], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Lists of texts of about ``limit`` characters, so that work arrays stay small."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part
    pa.default_memory_pool().release_unused()  # what earlier batches held goes back


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after the other, and the words per text."""
    plain = [" ".join(t.lower().split()) if t else "" for t in texts]
    counts = np.fromiter((p.count(" ") + 1 if p else 0 for p in plain), np.int64, len(plain))
    raw = np.frombuffer(" ".join(p for p in plain if p).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), counts
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    lengths = np.diff(np.concatenate((starts, [len(raw) + 1])))
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)[: len(raw)]
    values = _BYTES[raw] * _powers(int(lengths.max()) + 1)[place]
    values[gaps] = 0
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _GOLD), counts


def shingle_hashes(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of ``size`` words and their number per text.

    A text of fewer words has one shingle, all its words; an empty text has none.
    """
    words, counts = word_hashes(texts)
    n = len(words)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    total = np.zeros(n, np.uint64)
    factors = _powers(size)
    for k in range(size):
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - k)] = words[k:]
        total += np.where(left > k, ahead * factors[k], np.uint64(0))
    sizes = np.repeat(counts, counts)
    keep = (left >= size) | ((sizes < size) & (left == sizes))
    total = mix(total + np.minimum(left, size).astype(np.uint64))
    return total[keep], np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))


def segments(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each text's part of an array."""
    ends = np.cumsum(counts)
    return zip((ends - counts).tolist(), ends.tolist(), strict=True)
