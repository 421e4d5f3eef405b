"""Vectorised reading of texts: runs of documents as one byte array, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a longer document is worked on whole, at some 60 bytes a byte of text.
PIECE = 1 << 17


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about `most` bytes together."""
    i, n = 0, len(texts)
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def joined(texts: pa.Array, lower: bool = False, sep: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The texts as bytes, each followed by one `sep`, then 8 zeros; and where each starts (one more: the end). Null is empty."""
    raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
    s = bytes([sep])
    data = np.frombuffer(s.join([*raw, b""]) + b"\0" * 8, np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    return (_LOWER[data] if lower else data), at


def u8_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a little-endian number, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `[^\\x20\\x09-\\x0D]` before the padding."""
    w = ~_SEP[data[:-8]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], w, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    at = u8_at(data)
    h = mix64((at[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _K)
    k = 8
    idx = np.flatnonzero(size > k)
    while len(idx):
        h[idx] = mix64(h[idx] * np.uint64(0xD6E8FEB86659FD93) + (at[start[idx] + k] & _MASK[np.minimum(size[idx] - k, 8)]))
        k += 8
        idx = idx[size[idx] > k]
    return h


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive values from each position on (len - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = h[:m].copy()
    for i in range(1, n):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x += h[i : i + m]
        x ^= x >> np.uint64(29)
    return mix64(x)
