"""Vectorised word kernels over Arrow string columns (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15
_WORD = 0xD6E8FEB86659FD93
CHUNK = 1 << 20  # bytes of text handled at once; a longer text is handled alone


def _table(outside: list[tuple[int, int]]) -> np.ndarray:
    lut = np.ones(256, bool)
    for lo, hi in outside:
        lut[lo : hi + 1] = False
    return lut


#: bytes of ``[^\x20\x09-\x0D]``
NOT_SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, for text whose A-Z are lower-cased
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = {_MULT: _powers(_MULT, 4096)}


@dataclass
class Words:
    """Words of consecutive texts: word i is ``data[start[i]:end[i]]``, of text ``doc[i]``; text d has words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, mult: int = _MULT) -> np.ndarray:
        """64-bit hash of each word; another odd ``mult``, another hash."""
        lens = self.end - self.start
        if not len(lens):
            return np.zeros(0, np.uint64)
        at = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(at, lens)
        byte = self.data[inside + np.repeat(self.start, lens)]
        pow_ = _POW.setdefault(mult, _powers(mult, 4096))
        pow_ = pow_ if lens.max() <= len(pow_) else _powers(mult, int(lens.max()))
        term = (byte.astype(np.uint64) + np.uint64(1)) * pow_[inside]
        return mix(np.add.reduceat(term, at) + lens.astype(np.uint64) * np.uint64(_WORD))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string or binary column; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words_of(data: np.ndarray, off: np.ndarray, alphabet: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of the alphabet's bytes; none spans two texts."""
    if lower:
        data = LOWER[data]
    on = np.zeros(len(data) + 2, bool)
    on[1:-1] = alphabet[data]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins, ends = on[1:-1] & ~on[:-2], on[1:-1] & ~on[2:]
    begins[cut] = on[1:-1][cut]
    ends[cut - 1] = on[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def windows(h: np.ndarray, doc: np.ndarray, k: int, base: int = 0xA24BAED4963EE407) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of k words inside one text."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(base) + h[j : len(h) - k + 1 + j]
    return start, mix(out[start] + np.uint64(k))


#: an odd multiplier and its inverse modulo 2**64
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_OTHER = 0xD1B54A32D192ED03


def range_hashes(w: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``n`` words from word ``first``, by other hashes of the words than Words.hashes() gives."""
    h = w.hashes(_OTHER)
    if not len(first):
        return np.zeros(0, np.uint64)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)]
    return mix((total[first + n] - total[first]) * _powers(_INVERSE, len(h) + 1)[first] + n.astype(np.uint64))
