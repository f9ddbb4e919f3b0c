"""Words of whole Arrow text columns, found with numpy.

A batch of texts is one byte buffer with bounds: text ``t`` is
``data[bounds[t]:bounds[t + 1]]``. Words are runs of bytes outside
``\\x20\\x09-\\x0D``; they never span two texts. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column."""
    column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def runs(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, and where each text's runs begin."""
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    before[bounds[:-1][bounds[:-1] < len(solid)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin."""
    return runs(~SPACE[data], bounds)


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given stretches of the buffer as a binary array."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    data = np.ascontiguousarray(data)
    every = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(0, len(cuts) - 1, 2)))


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different stretches, and for every stretch its place among them."""
    found = slices(data, starts, ends).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def owners(first: np.ndarray) -> np.ndarray:
    """For every run the text it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
