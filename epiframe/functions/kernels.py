"""Kernels of the token codecs: numpy over the Arrow batches of nested list columns, a whole batch at once.

Each function here takes a layout and gives a column function (an Arrow UDF).  A batch is
10,000 rows at most, so memory is bounded whatever the table; rows never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from epiframe.functions.codes import RunCodec

#: Distances to entries of a codebook that are held at once.
DISTANCES = 1 << 20


def _udf(function: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    return arrow_udf(function, kind)


def _cut(a: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and where each begins; the last place is their number."""
    at = a.offsets.to_numpy().astype(np.int64)
    return a.values.slice(at[0], at[-1] - at[0]), at - at[0]


def _placed(a: pa.Array, widths: Sequence[int]) -> tuple[pa.Array, np.ndarray, tuple[np.ndarray, ...]]:
    """The innermost values of nested lists, which of them lie within ``widths``, and the places of those in (rows, *widths)."""
    index, inside = [np.arange(len(a))], np.ones(len(a), dtype=bool)
    for width in widths:
        a, at = _cut(a)
        sizes = np.diff(at)
        place = np.arange(len(a)) - np.repeat(at[:-1], sizes)
        index = [np.repeat(i, sizes) for i in index] + [place]
        inside = np.repeat(inside, sizes) & (place < width)
    return a, inside, tuple(i[inside] for i in index)


def _whole(a: pa.Array, widths: Sequence[int]) -> np.ndarray | None:
    """The values of nested lists that all have exactly ``widths`` and no nulls, as one array; None if any has not."""
    rows = len(a)
    for width in widths:
        a, at = _cut(a)
        if (np.diff(at) != width).any():
            return None
    return None if a.null_count else a.to_numpy(zero_copy_only=False).reshape(rows, *widths)


def _dense(a: pa.Array, widths: Sequence[int], fill) -> np.ndarray:
    """Nested lists as one array of (rows, *widths): longer lists are cut, and what is missing or null is ``fill``."""
    rows = len(a)
    if (whole := _whole(a, widths)) is not None:
        return whole
    a, inside, places = _placed(a, widths)
    values = (a.fill_null(fill) if a.null_count else a).to_numpy(zero_copy_only=False)
    out = np.full((rows, *widths), fill, dtype=values.dtype)
    out[places] = values[inside]
    return out


def _known(a: pa.Array, widths: Sequence[int]) -> np.ndarray:
    """Where :func:`_dense` has a value of its own."""
    out = np.zeros((len(a), *widths), dtype=bool)
    values, inside, places = _placed(a, widths)
    out[places] = values.is_valid().to_numpy(zero_copy_only=False)[inside]
    return out


def _lists(values: np.ndarray, kind: pa.DataType, null: np.ndarray) -> pa.Array:
    """The inverse of :func:`_dense`; ``null`` tells the rows that are null."""
    out = pa.array(values.ravel(), kind)
    for depth in range(values.ndim - 1, 0, -1):
        count = int(np.prod(values.shape[:depth]))
        at = pa.array(np.arange(count + 1) * values.shape[depth], pa.int32())
        out = pa.ListArray.from_arrays(at, out, mask=pa.array(null) if depth == 1 else None)
    return out


def _null(*columns: pa.Array) -> np.ndarray:
    return np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)


# --- marked groups ---------------------------------------------------------


def groups_parser(markers: Sequence[int], widths: Sequence[int]) -> Callable[[Column], Column]:
    """Tokens -> codes of each group, as :func:`epiframe.functions.tokens.parse_marked` has it: all rows step from marker to marker at once."""
    order = np.argsort(np.array(markers, np.int64), kind="stable")
    known, width, n = np.array(markers, np.int64)[order], np.array(widths, np.int64), len(markers)

    def parse(tokens: pa.Array) -> pa.Array:
        values, at = _cut(tokens)
        ids = values.fill_null(0).to_numpy(zero_copy_only=False)
        near = np.minimum(np.searchsorted(known, ids), n - 1)
        marks = np.flatnonzero((known[near] == ids) & values.is_valid().to_numpy(zero_copy_only=False))
        group = order[near[marks]]
        start, here, rows = np.full((len(tokens), n), -1), at[:-1].copy(), np.arange(len(tokens))
        while len(rows):
            k = np.searchsorted(marks, here[rows])
            rows, k = rows[k < len(marks)], k[k < len(marks)]
            inside = marks[k] < at[rows + 1]
            rows, k = rows[inside], k[inside]
            start[rows, group[k]] = marks[k] + 1
            here[rows] = marks[k] + 1 + width[group[k]]
        found = start.ravel() >= 0
        sizes = np.where(found, np.tile(width, len(tokens)), 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(start.ravel() - ends[:-1], sizes) + np.arange(ends[-1])
        place = np.where(place < np.repeat(np.repeat(at[1:], n), sizes), place, len(ids))  # behind the row's end: the zero
        codes = pa.concat_arrays([values, pa.array([0], values.type)]).take(pa.array(place))
        parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), codes, mask=pa.array(~found))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * n, pa.int32()), parts, mask=pa.array(_null(tokens)))

    return _udf(parse, "array<array<bigint>>")


# --- residual codebooks ----------------------------------------------------


def residual_coder(steps: int, dims: int, width: int, segment: int, books: Sequence[Sequence[Sequence[float]]]) -> Callable[[Column], Column]:
    """Chunk (steps, dims) -> codes (pieces of ``width`` components, books, segments).

    The code of each book in turn is the entry nearest to what the books before left over (ties: the smaller code); the
    last piece is filled with zeros.  What is null counts as NaN, from which every entry is equally far.
    """
    entries, pieces, segments = [np.array(b, np.float64) for b in books], -(-dims // width), steps // segment

    def encode(chunk: pa.Array) -> pa.Array:
        wide = np.zeros((len(chunk), segments * segment, pieces * width))
        wide[..., :dims] = _dense(chunk, (steps, dims), np.nan)[:, : segments * segment]
        rest = wide.reshape(-1, segments, segment, pieces, width).transpose(0, 3, 1, 2, 4).reshape(-1, segment * width)
        codes = np.zeros((len(rest), len(entries)), np.int64)
        for n, book in enumerate(entries):
            some = max(1, DISTANCES // len(book))
            for lo in range(0, len(rest), some):
                part = np.ascontiguousarray(rest[lo : lo + some].T)
                gap = np.zeros((len(book), part.shape[1]))
                for j in range(book.shape[1]):  # component by component, so that sums round as a fold's do
                    d = part[j] - book[:, j, None]
                    gap += d * d
                codes[lo : lo + some, n] = gap.argmin(axis=0)
            rest = rest - book[codes[:, n]]
        return _lists(codes.reshape(-1, pieces, segments, len(entries)).transpose(0, 1, 3, 2), pa.int64(), _null(chunk))

    return _udf(encode, "array<array<array<bigint>>>")


def residual_decoder(steps: int, dims: int, width: int, segment: int, books: Sequence[Sequence[Sequence[float]]]) -> Callable[..., Column]:
    """The inverse of :func:`residual_coder` from the codes (books, segments) of each piece: sums of entries; codes beyond a book count as its last; null where a piece is."""
    entries, segments = [np.array(b, np.float64) for b in books], steps // segment

    def decode(*pieces: pa.Array) -> pa.Array:
        out = []
        for piece in pieces:
            codes = _dense(piece, (len(entries), segments), 0)
            total = sum(book[np.clip(codes[:, n], 0, len(book) - 1)] for n, book in enumerate(entries))
            out.append(total.reshape(len(piece), segments * segment, width))
        return _lists(np.concatenate(out, axis=2)[..., :dims], pa.float64(), _null(*pieces))

    return _udf(decode, "array<array<double>>")


# --- constrained bit sequences ---------------------------------------------


class _Runs:
    """A batch of bit sequences by their runs: ``keep`` are those that stand, first and last ones and those longer than ``shortest``."""

    def __init__(self, bits: pa.Array, shortest: int):
        values, self.at = _cut(bits)
        b = values.fill_null(0).to_numpy(zero_copy_only=False)
        begins = np.zeros(len(b) + 1, dtype=bool)
        begins[self.at] = True
        new = begins[:-1].copy()
        new[1:] |= b[1:] != b[:-1]
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(b)))
        first = begins[self.start]
        last = begins[self.start + self.size]
        self.bit, self.keep = b[self.start], first | last | (self.size > shortest)

    def repaired(self) -> np.ndarray:
        """All bits, where a run that does not stand has the value of the last one that does."""
        from_run = np.maximum.accumulate(np.where(self.keep, np.arange(len(self.keep)), 0))
        return np.repeat(self.bit[from_run], self.size)


def bits_valid(shortest: int) -> Callable[[Column], Column]:
    def valid(bits: pa.Array) -> pa.Array:
        runs = _Runs(bits, shortest)
        out = np.ones(len(bits), dtype=bool)
        out[np.searchsorted(runs.at, runs.start[~runs.keep], "right") - 1] = False
        return pa.array(out, mask=_null(bits))

    return _udf(valid, "boolean")


def _repair(bits: pa.Array, shortest: int) -> pa.ListArray:
    runs = _Runs(bits, shortest)
    return pa.ListArray.from_arrays(pa.array(runs.at, pa.int32()), pa.array(runs.repaired(), pa.int32()), mask=pa.array(_null(bits)))


def bits_repair(shortest: int) -> Callable[[Column], Column]:
    def repair(bits: pa.Array) -> pa.Array:
        return _repair(bits, shortest)

    return _udf(repair, "array<int>")


class _Walk:
    """All rows' state on the way through their sequences; ``zero`` counts the sequences that have a 0 at the next place."""

    def __init__(self, ways: np.ndarray, shortest: int, rows: int):
        self.ways, self.shortest = ways, shortest
        self.last, self.run, self.first = np.full(rows, -1), np.zeros(rows, np.int64), np.ones(rows, dtype=bool)

    def zero(self, left: int) -> np.ndarray:
        """None where a 0 would end an inner run too early."""
        ways = self.ways[left]
        on = ways[np.minimum(self.run + 1, self.shortest + 1) - 1, self.first.astype(np.int64)]
        turn = np.where(self.first | (self.run > self.shortest), ways[0, :1], 0)
        return np.where(self.last < 0, ways[0, 1:], np.where(self.last == 0, on, turn))

    def step(self, bit: np.ndarray) -> None:
        same = self.last == bit
        self.run = np.where(same, self.run + 1, 1)
        self.first = self.first & (same | (self.last < 0))
        self.last = bit


def _ways(codec: RunCodec, length: int, shortest: int, kind: type) -> np.ndarray:
    table = [[[codec._count(left, run, first) for first in (False, True)] for run in range(1, shortest + 2)] for left in range(length)]
    return np.array(table, dtype=kind).reshape(length, shortest + 1, 2)


def bits_coder(codec: RunCodec, length: int, shortest: int, base: int, kind: type) -> Callable[[Column], Column]:
    """Bits -> digits of the repaired sequence's rank; ``kind`` is the type of ranks (object: of any size).  Short sequences count as if zeros followed."""
    ways, digits = _ways(codec, length, shortest, kind), codec.digits

    def encode(bits: pa.Array) -> pa.Array:
        b, walk = _dense(_repair(bits, shortest), (length,), 0), _Walk(ways, shortest, len(bits))
        rank = np.zeros(len(bits), dtype=kind)
        for i in range(length):
            rank = rank + np.where(b[:, i] == 1, walk.zero(length - 1 - i), 0)
            walk.step(b[:, i])
        out = [(rank // base**i % base).astype(np.int64) for i in range(digits - 1, -1, -1)]
        return _lists(np.stack(out, axis=1) if out else np.zeros((len(bits), 0), np.int64), pa.int64(), _null(bits))

    return _udf(encode, "array<bigint>")


def bits_decoder(codec: RunCodec, length: int, shortest: int, base: int, kind: type) -> Callable[[Column], Column]:
    """Digits -> the sequence of their rank; digits are clamped to the base, and ranks past the last count as the last."""
    ways, most = _ways(codec, length, shortest, kind), max(codec.total - 1, 0)

    def decode(digits: pa.Array) -> pa.Array:
        sizes = np.diff(_cut(digits)[1])
        d = np.clip(_dense(digits, (int(sizes.max(initial=0)),), 0), 0, base - 1).astype(kind)
        rank = np.zeros(len(digits), dtype=kind)
        for i in range(d.shape[1]):
            rank = np.where(i < sizes, np.minimum(rank * base + d[:, i], most), rank)
        walk, out = _Walk(ways, shortest, len(digits)), np.zeros((len(digits), length), np.int32)
        for i in range(length):
            zero = walk.zero(length - 1 - i)
            out[:, i] = rank >= zero
            rank = np.where(rank >= zero, rank - zero, rank)
            walk.step(out[:, i])
        return _lists(out, pa.int32(), _null(digits))

    return _udf(decode, "array<int>")


# --- errors of chunks ------------------------------------------------------


def part_sums(spans: Sequence[tuple[int, int, bool]], close: float, threshold: float) -> Callable[..., Column]:
    """(guess, truth, past) -> sums (l1, hits, n) of a chunk for each span (first dimension, width, binary) over its steps.

    Steps that lie in the past mask, or beyond it, count nothing, nor does what either side lacks.  Binary spans compare
    the sides of the threshold.
    """
    dims = max(at + width for at, width, _ in spans)

    def sums(guess: pa.Array, truth: pa.Array, past: pa.Array) -> pa.Array:
        steps = (max((int(np.diff(_cut(c)[1]).max(initial=0)) for c in (guess, truth))),)
        g, t = (_dense(c, (*steps, dims), np.nan) for c in (guess, truth))
        counts = _known(guess, (*steps, dims)) & _known(truth, (*steps, dims)) & ~_dense(past, steps, True).astype(bool)[..., None]
        out = []
        for at, width, binary in spans:
            here = slice(at, at + width)
            x, y, c = g[..., here], t[..., here], counts[..., here]
            # Spark's order: NaN is above every threshold.
            gap = np.abs(((x > threshold) | np.isnan(x)) * 1.0 - ((y > threshold) | np.isnan(y))) if binary else np.abs(x - y)
            out.append((np.where(c, gap, 0.0).sum((1, 2)), (c & (gap < close)).sum((1, 2)), c.sum((1, 2))))
        l1, hits, n = (np.stack(x, axis=1).ravel() for x in zip(*out))
        rows = pa.StructArray.from_arrays([pa.array(l1, pa.float64()), pa.array(hits, pa.int64()), pa.array(n, pa.int64())], names=["l1", "hits", "n"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(guess) + 1) * len(spans), pa.int32()), rows)

    return _udf(sums, "array<struct<l1:double,hits:bigint,n:bigint>>")
