"""Spans of bytes in Arrow batches of texts, dictionary-encoded without a Python object per span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in the bytes) of consecutive rows; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags; no run goes over a position of cuts (ascending, within the flags)."""
    starts, ends = inside.copy(), inside.copy()
    edge = np.zeros(len(inside) + 1, bool)
    edge[cuts] = True
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def encoded(kept: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Numbers of spans, and the distinct spans by number.

    kept holds the spans' bytes one after another, lengths their sizes.
    """
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def tally(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order with their number of rows, and the sums of values."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(keys)]])).astype(np.int64)
    sums = [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]
    return sorted_keys[first], counts, *sums
