"""Vectorised text primitives over Arrow string columns (numpy, inside tasks).

Texts are handled in slices of about ``SLICE_BYTES`` so that the working
arrays of a task stay small, whatever the batch size; a longer text is a slice
of its own. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

#: Odd multiplier of the word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def as_binary(column: pa.Array) -> pa.LargeBinaryArray:
    """A string column as bytes, nulls as empty."""
    return pc.fill_null(column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
                        .cast(pa.large_binary()), b"")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about ``limit`` bytes."""
    column = as_binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of every row's first
    word (one more entry than rows). Words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of byte starts and ends that gives the 64-bit hash of every
    span: a polynomial in the bytes, by prefix sums taken once."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], out=total[1:])
    shift = _power(_INVERSE, n + 1)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (total[ends] - total[starts]) * shift[starts]
        value += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mix64(value)

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hasher`` for one set of spans."""
    return span_hasher(data)(starts, ends)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from every place on."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * _power(_INVERSE, n + 1)[:n + 1 - k])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of every row and the row's first
    shingle. A row with 1 to ``k - 1`` words has one shingle of them all."""
    n = len(hashes)
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    if not n:
        return np.zeros(0, np.uint64), out_first
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    row_end = np.repeat(first[1:], made)
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], made) + np.repeat(first[:-1], made)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = at + j
        part = np.where(here < row_end, padded[np.minimum(here, n)], np.uint64(0))
        value = value * np.uint64(0x9FB21C651E98DF25) + part
        value ^= value >> np.uint64(29)
    return mix64(value), out_first


def sequence_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of every run ``hashes[low:high]``, by prefix sums."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, n)[:n], out=total[1:])
    value = (total[high] - total[low]) * _power(_INVERSE, n + 1)[low]
    value += (high - low).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix64(value)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends (white space at both ends left out), row and
    number in the row (from 0, by line feeds) of the lines that hold a word."""
    starts, ends, _ = words(data, offsets)
    feeds = np.flatnonzero(data == 10)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # A word opens a line when a line feed or a row border lies before it.
    feed_no = np.searchsorted(feeds, starts)
    row = np.searchsorted(offsets, starts, "right") - 1
    opens = np.concatenate([[True], (feed_no[1:] != feed_no[:-1]) | (row[1:] != row[:-1])])
    head = np.flatnonzero(opens)
    last = np.append(head[1:], len(starts)) - 1
    row = row[head]
    return starts[head], ends[last], row, feed_no[head] - np.searchsorted(feeds, offsets[row])
