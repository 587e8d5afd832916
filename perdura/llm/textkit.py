"""Texts of an Arrow batch as one byte array, with words and rolling hashes in numpy.

Everything here works on a bounded slice of rows: `slices` cuts a batch by bytes
so that the arrays of a task stay small however long the texts of a batch are (a
single text longer than the bound is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts have at most `most` bytes together."""
    _, offsets = bytes_of(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * BASE)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


class RollingHash:
    """64-bit hashes of any byte spans, from one running sum over the bytes."""

    def __init__(self, data: np.ndarray):
        size = (len(data) >> 20) + 1 << 20
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words between white space.

    A text's words are those numbered first[i] to first[i + 1].
    """
    space = np.ones(len(data) + 1, dtype=bool)
    np.take(SPACE, data, out=space[:-1])
    begins = np.empty(len(data) + 1, dtype=bool)
    begins[0] = True
    begins[1:] = space[:-1]
    inner = offsets[1:-1]
    begins[inner] = True
    start = np.flatnonzero(begins[: len(data)] & ~space[: len(data)])
    ends = space
    ends[inner] = True
    stop = np.flatnonzero(ends)
    end = stop[np.searchsorted(stop, start + 1)]
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct hashed shingles in rising order.

    A-Z count as a-z. A text with fewer words gives its whole sequence as one
    shingle, a text without words gives none.
    """
    data = LOWER[data]
    start, end, first = word_spans(data, offsets)
    word = RollingHash(data).spans(start, end)
    n = len(word)
    runs = np.zeros(max(0, n - words + 1), dtype=U64)
    for k in range(words):
        runs = mix(runs + word[k : k + len(runs)] * (BASE + U64(2 * k)))
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        elif b > a:
            short = np.zeros(1, dtype=U64)
            for k in range(a, b):
                short = mix(short + word[k : k + 1] * BASE + U64(b - a))
            yield short
        else:
            yield np.zeros(0, dtype=U64)
