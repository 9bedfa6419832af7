"""Vectorised word scanning and rolling hashes over Arrow string columns.

Words are maximal runs of bytes other than space, tab, newline, vertical tab,
form feed and carriage return.  UTF-8 keeps those bytes out of multi-byte
characters, so scanning bytes equals scanning the text.  Every function works
on a chunk: the concatenated bytes of several documents and their offsets.
Memory is about 60 bytes for each byte of a chunk; a chunk holds ``CHUNK``
bytes, or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        seq = np.full(size, base, dtype=np.uint64)
        seq[0] = 1
        have = np.cumprod(seq, dtype=np.uint64)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``size`` bytes."""
    raw, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + size, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a chunk: byte starts and ends, 64-bit hashes, and each document's range ``first[i]:first[i+1]``."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        n = len(raw)
        inside = ~_SEP[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = span_hash(raw, self.start, self.end, _LOWER if lower else _TABLE)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(table[raw] * _power(_BASE, len(raw)), out=total[1:])
    back = _power(_INVERSE, len(raw) + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` hashes, across document edges as well."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=total[1:])
    return mix((total[width:] - total[:n]) * _power(_INVERSE, len(hashes))[:n])


def window_rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of one document starts, and the document of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - skip[doc] + first[:-1][doc], doc
