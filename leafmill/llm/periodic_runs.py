"""Maximal periodic stretches of words, found by block convolution at dyadic scales.

A run is a stretch of consecutive words whose smallest period is q, of ``LEAST_LENGTH``
words and ``LEAST_EXPONENT`` periods at least, that no neighbouring word extends. For
periods from L to 2L - 1, L a power of two, the words are cut into blocks of L: a run
holds a whole block and, q words on, the block again. The sum of squared differences of a
block and each place of the window behind it comes from a number-theoretic transform,
that is exactly, in integers modulo a prime; where it is zero the distance is a seed,
which is then extended by comparing words. A difference that is zero only modulo the
prime fails that comparison, and a true zero is never missed.

Two exact rules keep the transforms few. A block can't come again within 2L words unless
each of its words does, so the largest distance from a word to its next occurrence is kept
per block, from scale to scale. And a block whose whole window lies in a run of smaller
period gives nothing new: two periods p and q on p + q words make a common one.

Texts are read whole, each by itself; there is no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.spark import bounded_batches
from leafmill.llm.words import BATCH_CHARS

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
PRIME = 15 * (1 << 27) + 1  # transforms of up to 2^27 places
GENERATOR = 31
CELLS = 1 << 18  # places transformed at once
STEPS = 24  # words that all seeds are extended by together, before each goes on alone
FOUND = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def _roots(size: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of this order, as many as half of it."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.ones(max(1, size // 2), np.uint64)
    have = 1
    while have < len(powers):
        more = min(have, len(powers) - have)
        powers[have : have + more] = powers[:more] * np.uint64(pow(root, have, PRIME)) % np.uint64(PRIME)
        have += more
    return powers


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row; lengths are powers of two."""
    prime = np.uint64(PRIME)
    n, size = rows.shape
    out = rows.astype(np.uint64).reshape(n, 1, size)
    while out.shape[2] > 1:  # decimation in frequency: halves become sums and turned differences
        half = out.shape[2] // 2
        low, high = out[:, :, :half], out[:, :, half:]
        turned = (low + prime - high) % prime * _roots(2 * half, inverse) % prime
        out = np.concatenate(((low + high) % prime, turned), axis=1).reshape(n, -1, half)
    out = out.reshape(n, size)  # each step puts the odd places behind all even ones
    if inverse:
        out = out * np.uint64(pow(size, PRIME - 2, PRIME)) % prime
    return out


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Modulo the prime: sum of (block[i] - window[e + i])^2 for e < L; windows have 2L places."""
    prime = np.uint64(PRIME)
    n, length = blocks.shape
    squares = np.zeros((n, 2 * length + 1), np.uint64)
    np.cumsum(windows * windows % prime, axis=1, out=squares[:, 1:])
    of_windows = (squares[:, length : 2 * length] - squares[:, :length]) % prime
    of_blocks = (blocks * blocks % prime).sum(1, keepdims=True) % prime
    turned = np.zeros((n, 2 * length), np.uint64)  # correlation is convolution with the reversed block
    turned[:, 0] = blocks[:, 0]
    turned[:, length + 1 :] = blocks[:, :0:-1]
    products = transform(transform(turned) * transform(windows) % prime, inverse=True)[:, :length]
    return (of_windows + of_blocks + 2 * (prime - products)) % prime


def next_distances(words: np.ndarray) -> np.ndarray:
    """How many places ahead each word comes again; a very large number if never."""
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    ahead = np.full(len(words), np.iinfo(np.int64).max)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return ahead


def _ahead(words: np.ndarray, at: int, period: int) -> int:
    """The first place from ``at`` on whose word is not the one a period later."""
    step, end = 64, len(words) - period
    while at < end:
        size = min(step, end - at)
        other = words[at : at + size] != words[at + period : at + period + size]
        first = int(other.argmax())
        if other[first]:
            return at + first
        at, step = at + size, 2 * step
    return at


def _behind(words: np.ndarray, at: int, period: int) -> int:
    """The least place down from ``at`` from which all words equal the one a period later."""
    step = 64
    while at > 0:
        size = min(step, at)
        other = words[at - size : at][::-1] != words[at - size + period : at + period][::-1]
        first = int(other.argmax())
        if other[first]:
            return at - first
        at, step = at - size, 2 * step
    return at


def _extended(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each seed: first place and end of the stretch whose words come again a period later."""
    left, right = at.copy(), at.copy()
    on = np.arange(len(at))
    for _ in range(STEPS):
        ahead = right[on] + period[on]
        on = on[(ahead < len(words)) & (words[right[on]] == words[np.minimum(ahead, len(words) - 1)])]
        right[on] += 1
    for k in on.tolist():
        right[k] = _ahead(words, int(right[k]), int(period[k]))
    on = np.arange(len(at))
    for _ in range(STEPS):
        before = left[on] - 1
        on = on[(before >= 0) & (words[before] == words[np.minimum(before + period[on], len(words) - 1)])]
        left[on] -= 1
    for k in on.tolist():
        left[k] = _behind(words, int(left[k]), int(period[k]))
    return left, right


def _within(found: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether one of the found (start, end, period) holds all of each stretch."""
    if not len(found):
        return np.zeros(len(start), bool)
    found = found[np.argsort(found[:, 0], kind="stable")]
    reach = np.maximum.accumulate(found[:, 1])
    at = np.searchsorted(found[:, 0], start, "right") - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] >= end)


def _seeds(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all blocks that come again at a distance from L to 2L - 1."""
    places, distances = [], []
    rows = max(1, CELLS // (2 * length))
    for first in range(0, len(starts), rows):
        part = starts[first : first + rows]
        blocks = words[part[:, None] + np.arange(length)].astype(np.uint64)
        windows = words[np.minimum(part[:, None] + np.arange(length, 3 * length), len(words) - 1)].astype(np.uint64)
        row, offset = np.nonzero(squared_differences(blocks, windows) == 0)
        places.append(part[row])
        distances.append(offset + length)
    return np.concatenate(places), np.concatenate(distances)


def runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, length, period) of all runs of an array of word numbers, by start and period.

    Several texts may stand one after the other with a number of its own between each two;
    ``longest`` is then the length of the longest text.
    """
    found = np.empty((0, 3), np.int64)
    n = len(words)
    longest = n if longest is None else longest
    ahead = next_distances(words) if n else np.empty(0, np.int64)
    length = 1
    while LEAST_EXPONENT * length <= longest and len(ahead):
        starts = np.flatnonzero(ahead < 2 * length) * length
        starts = starts[~_within(found, starts, starts + 3 * length)]
        if len(starts):
            place, period = _seeds(words, starts, length)
            new = (place + length + period <= n) & ~_within(found, place, place + length + period)
            place, period = place[new], period[new]
            order = np.lexsort((place, period))
            place, period = place[order], period[order]
            head = np.ones(len(place), bool)  # the next block at the same distance is the same stretch
            head[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + length)
            place, period = place[head], period[head]
            left, right = _extended(words, place, period)
            size = right + period - left
            long = size >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
            same_scale = np.unique(np.column_stack((left, left + size, period))[long], axis=0)
            for period in np.unique(same_scale[:, 2]):  # a stretch within one of smaller period has that one
                some = same_scale[same_scale[:, 2] == period]
                found = np.concatenate((found, some[~_within(found, some[:, 0], some[:, 1])]))
        pairs = len(ahead) // 2
        ahead = np.maximum(ahead[: 2 * pairs : 2], ahead[1 : 2 * pairs : 2])
        length *= 2
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return np.column_stack((found[:, 0], found[:, 1] - found[:, 0], found[:, 2]))


def _found(texts: pa.Array) -> pa.StructArray:
    split = pc.ascii_split_whitespace(texts)
    flat, cuts = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(flat), 0)
    sums = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    cuts = sums[cuts]
    flat = flat.filter(filled)
    counts = np.diff(cuts)
    number = flat.dictionary_encode()
    n = len(counts)
    words = np.empty(len(flat) + n, np.int64)  # a number of its own ends each text
    owner = np.repeat(np.arange(n), counts)
    words[np.arange(len(flat)) + owner] = number.indices.to_numpy(zero_copy_only=False)
    words[cuts[1:] + np.arange(n)] = len(number.dictionary) + np.arange(n)
    all_runs = runs(words, int(counts.max(initial=0)))
    of_text = np.searchsorted(cuts[:-1] + np.arange(n), all_runs[:, 0], "right") - 1
    first = all_runs[:, 0] - of_text  # among all words, without the ends
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, first + all_runs[:, 2], 1)
    np.add.at(change, first + all_runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    left = np.concatenate(([0], np.cumsum(kept)))[cuts]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " ")
    spans = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (first - cuts[of_text], all_runs[:, 1], all_runs[:, 2])], ["start", "length", "period"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(of_text, minlength=n))))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), collapsed], ["n_words", "runs", "collapsed"])


def found(texts: pa.Array) -> pa.StructArray:
    """(n_words, runs, collapsed) of each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    parts, at = [], 0
    while at < len(texts):  # texts of about BATCH_CHARS bytes together, or one longer text
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, "right")))
        parts.append(_found(pa.concat_arrays([texts.slice(at, end - at)])))
        at = end
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else _found(texts)


def with_runs(docs: DataFrame, text_col: str = "text", into: str = "periodic", keep: Sequence[str] | None = None) -> DataFrame:
    """The rows with their columns, or those to ``keep``, and a struct(n_words, runs, collapsed).

    Words are what stands between blanks and the control characters 9 to 13, as they are
    written. ``collapsed`` has the words, one blank between each two, without those that a
    run holds after its first period. A text without words, or null, has no runs and is
    collapsed to an empty one. Repeated rows are read like any other, an empty table gives
    none; a column that is called ``into`` already is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[c] for c in kept]).add(into, T.DataType.fromDDL(FOUND))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found(batch.columns[-1])], schema.names)

    return rows.mapInArrow(add, schema)
