"""Hashed word-run features by an Aho-Corasick dictionary (operator 12's scan).

The distinct words of a piece of text go into an automaton, each bounded by a
delimiter on both sides and carrying its CRC-32 and length.  One scan over the
piece emits the payloads in text order.  The CRC of a run of words follows
from its words' payloads alone: crc(a + b) is crc(a) moved over len(b) zero
bytes, xor crc(b), and the move is a linear map that depends on the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np

PIECE = 1 << 20  # bytes scanned at a time, up to the next delimiter
_POLY = 0xEDB88320

#: a-z, 0-9 and bytes of other than ASCII characters are parts of words, A-Z become a-z, the rest delimits
_WORD = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32
_FOLD = np.frombuffer(bytes(_WORD), np.uint8)


def _apply(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of the 32 bits, on many CRCs."""
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where((crc >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _zero_byte() -> np.ndarray:
    out = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (_POLY if c & 1 else 0)
        out.append(c)
    return np.array(out, np.uint32)


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from those of a and b and the byte length of b."""
    out, move, rest = first.copy(), _zero_byte(), length.astype(np.int64)
    while rest.any():
        odd = (rest & 1).astype(bool)
        out[odd] = _apply(move, out[odd])
        move, rest = _apply(move, move), rest >> 1
    return out ^ second


def _scanned(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, CRC, length) of the words of a piece that starts and ends with a delimiter, in text order."""
    words = set(text.split(" "))
    words.discard("")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    crc, length = [], []
    for i, w in enumerate(words):
        machine.add_word(f" {w} ", i)
        crc.append(zlib.crc32(w.encode("latin-1")))
        length.append(len(w))
    machine.make_automaton()
    hits = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2)
    return hits[:, 0], np.array(crc, np.uint32)[hits[:, 1]], np.array(length, np.int64)[hits[:, 1]]


def payloads(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, CRC, length) of all words, piece by piece in order; a word never crosses rows."""
    folded = np.concatenate([[np.uint8(32)], np.insert(_FOLD[raw], off[1:], 32)]) if len(off) > 1 else np.zeros(0, np.uint8)
    ends = off[1:] + np.arange(1, len(off))  # places of the rows' closing delimiters
    gaps = np.flatnonzero(folded == 32)
    at = 0
    while at < len(folded) - 1:
        stop = int(gaps[min(np.searchsorted(gaps, at + PIECE), len(gaps) - 1)])
        end, crc, length = _scanned(folded[at:stop + 1].tobytes().decode("latin-1"))
        yield np.searchsorted(ends, end + at), crc, length
        at = stop


def run_buckets(raw: np.ndarray, off: np.ndarray, longest: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row the buckets (CRC modulo ``buckets``) of all runs of 1 to ``longest`` words joined by a space; and the rows' words."""
    found = list(payloads(raw, off))
    row, crc, length = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    rows, kinds = [row], [crc % buckets]
    space, run = np.uint32(zlib.crc32(b" ")), crc
    for j in range(1, longest):
        if len(crc) <= j:
            break
        tail = crc_joined(np.full(len(crc) - j, space), crc[j:], length[j:])
        run = crc_joined(run[:-1], tail, length[j:] + 1)
        same = row[j:] == row[:-j]
        rows.append(row[:-j][same])
        kinds.append((run % buckets)[same])
    row_of, kind = np.concatenate(rows), np.concatenate(kinds)
    order = np.argsort(row_of, kind="stable")
    cuts = np.searchsorted(row_of[order], np.arange(1, len(off) - 1))
    return np.split(kind[order], cuts) if len(off) > 1 else [], np.bincount(row, minlength=len(off) - 1)
