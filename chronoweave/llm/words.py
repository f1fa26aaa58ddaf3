"""Vectorised words, word hashes and shingles over Arrow string columns.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``;
``A-Z`` are lower-cased, all other characters stay as they are.  Everything
works on the UTF-8 buffer of a whole Arrow batch, so no Python string is
made per document or word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_pow: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift-multiply), vectorised, in place of a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _pow or len(_pow[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            out.append(p)
        _pow[:] = out
    return _pow[0], _pow[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(col: pa.Array, piece_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in row order, row offsets into the hashes).

    Rows are hashed in pieces of about ``piece_bytes`` so that the work
    arrays stay small; a longer row is one piece of its own.
    """
    raw, off = buffers(col)
    hashes, counts, row = [], np.zeros(len(off) - 1, np.int64), 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + piece_bytes, side="right")) - 1)
        h, c = _hash_piece(raw[off[row]:off[end]], off[row:end + 1] - off[row])
        hashes.append(h)
        counts[row:end] = c
        row = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
            np.concatenate([[0], np.cumsum(counts)]))


def _hash_piece(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = off[:-1][off[:-1] < len(raw)]
    first[cut] = solid[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    up, down = _powers(len(raw))
    value = _BYTE[raw]
    value *= up[:len(raw)]
    value[~solid] = 0
    h = np.add.reduceat(value, starts)
    h *= down[starts]
    return mix(h), np.diff(np.searchsorted(starts, off))


def shingle_sets(hashes: np.ndarray, off: np.ndarray, k: int = 5):
    """Yield, row by row, the sorted distinct hashes of the ``k``-word shingles.

    A row with fewer words has its whole sequence as one shingle; a row
    without words has none.
    """
    n = len(hashes)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[:n - j if j else n] = hashes[j:]
        acc = acc * _M + part
    acc = mix(acc)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            yield np.unique(acc[a:b - k + 1])
        elif b > a:
            x = b - a  # the count of words sets short sequences apart
            for w in hashes[a:b].tolist():
                x = (x * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([x ^ 0x5851F42D4C957F2D], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
