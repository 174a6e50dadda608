"""Whole batches of texts as flat numpy arrays: characters, words and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tilewright.llm.common import mix64

_CODES = np.arange(256)
#: Bytes of words by the contracts' rule; every byte of a character beyond ASCII counts.
IS_WORD = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
#: Weights by place in the word; places beyond the table start again.
_PLACE = mix64(np.arange(4096, dtype=np.uint64) + np.uint64(977)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the n + 1 bounds between its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def byte_sizes(column: pa.Array) -> list[int]:
    """The size of each row of a text column, without making strings of it; null is 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in turn, and the n + 1 bounds of the rows' words."""
    data = LOWER[data]
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    words = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), words
    where = np.flatnonzero(inside)
    index = np.cumsum(first)[where] - 1
    begins = np.searchsorted(where, starts)
    terms = _BYTE[data[where]] * _PLACE[(where - starts[index]) & 4095]
    return mix64(np.add.reduceat(terms, begins)), words


def shingles(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k consecutive values (a shorter row that is not empty: of all it has), and their bounds."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    index = np.arange(out[-1]) - np.repeat(out[:-1], counts) + np.repeat(bounds[:-1], counts)
    last = np.repeat(bounds[1:], counts)
    total = np.zeros(len(index), np.uint64)
    for j in range(k):
        here = index + j
        ok = here < last
        total += np.where(ok, values[np.minimum(here, len(values) - 1)], np.uint64(j + 1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1) | 1)
    return mix64(total), out
