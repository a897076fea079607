"""Arrow batches of texts as flat numpy arrays: words, hashes and sums per document.

Everything works on the UTF-8 bytes of a slice of the batch; no Python object
is made per word.  Words are the runs of bytes other than the six ASCII white
space characters.  Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19
#: The same where many arrays of 64 bits a byte are held beside the text.
SMALL_SLICE_BYTES = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


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


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; the spans are ascending, disjoint and not empty."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, _STEP, np.uint64)) if longest > 64 else _POWERS
    done, sizes = 0, np.cumsum(lengths)
    while done < len(starts):  # in pieces, so that scratch memory is bounded
        before = sizes[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(sizes, before + (1 << 20), "right")))
        n = lengths[done:to]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        value = BYTE_CODES[data[inside + np.repeat(starts[done:to], n)]] * powers[inside]
        out[done:to] = np.add.reduceat(value, first)
        done = to
    return mix(out + lengths.astype(np.uint64))


_POWERS = np.cumprod(np.full(64, _STEP, np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's range."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive items of one row, and where each starts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * POSITION[i]
    at = np.flatnonzero(rows[: len(total)] == rows[n - 1 :])
    return mix(total[at]), at


POSITION = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the bytes and the rows' offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, first[offsets]
