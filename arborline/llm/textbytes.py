"""Words of whole texts as arrays, straight from Arrow's buffers.

A word is a maximal run without the six ASCII white-space characters; those are single bytes in
UTF-8, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into (rows, bytes, offsets of the texts in bytes); null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of the texts among the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | first[1:-1]
    ends = ink
    ends[:-1] &= ~ink[1:] | first[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans don't overlap and are in order)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    bytes_ = data[np.repeat(starts, lengths) + inside].astype(np.uint64)
    terms = (bytes_ + np.uint64(1)) * mix(inside.astype(np.uint64))
    sums = np.add.reduceat(np.append(terms, np.uint64(0)), total[:-1])
    sums[lengths == 0] = 0
    return mix(sums ^ mix(lengths.astype(np.uint64)))


def count_in(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
