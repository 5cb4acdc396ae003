"""Words of whole texts as 64-bit numbers.

The operators count, compare and look up words, so that they need a number for
each word and not the word itself. Texts stay in the Arrow buffer of their
batch; boundaries and hashes come from vectorised passes over its bytes, a
block of about a megabyte at a time, so memory follows the batch and not the
length of a text. Words are runs of bytes outside 0x20 and 0x09-0x0D, which
never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for operators that compare words without it.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUE = np.random.default_rng(20250301).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.fill_null("").cast(pa.large_string())
    _, where, data = wide.buffers()
    offsets = np.frombuffer(where, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Word boundaries of a batch of texts: starts, ends, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        inside = ~between[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_text)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` lower-cases A-Z first."""
        return span_hashes(self.data, self.starts, self.ends, _FOLDED if fold else _VALUE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """A 64-bit hash of each byte span. Spans are ordered and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        n = int(ends[j - 1] - at)
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[at : at + n]] * up[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[np.minimum(s, n - 1)] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, in order, and the first window of each text.

    A text with fewer words has one window, which is all of them; a text
    without words has none.
    """
    n = words.per_text
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    out = np.zeros(len(at), np.uint64)
    stop = np.repeat(words.first[1:], count)
    step = np.uint64(0xD6E8FEB86659FD93)
    for j in range(width):
        there = at + j < stop
        out[there] = mix(out[there] * step + hashes[at[there] + j] + np.uint64(1))
    return out, first


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group in ascending order, and the new group starts."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = first[:-1][first[:-1] < first[1:]]
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], before[first]


def batches(table: Iterator[pa.RecordBatch], limit: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text, one row at least."""
    for batch in table:
        sizes = np.diff(text_bytes(batch.column(text))[1])
        run, start = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if run and run + n > limit:
                yield batch.slice(start, i - start)
                run, start = 0, i
            run += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker lives on after the task


def list_column(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column of ragged groups."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
