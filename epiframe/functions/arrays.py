"""Column algebra over ARRAY<DOUBLE> vectors and ARRAY<ARRAY<DOUBLE>> chunks; all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(vector: Col, start: int, width: int) -> Column:
    """``width`` components from ``start`` (0-based)."""
    return F.slice(col(vector), start + 1, width)


def flat_part(chunk: Col, start: int, width: int) -> Column:
    """A part of a 2-D value after its last two axes were flattened."""
    return part(F.flatten(col(chunk)), start, width)


def join_parts(*vectors: Col) -> Column:
    return F.concat(*(col(v) for v in vectors))


def take(vector: Col, places: Sequence[int]) -> Column:
    """Components at the given 0-based places, in that order."""
    return F.array(*(F.element_at(col(vector), p + 1) for p in places))


def reorder_blocks(vector: Col, first: int, second: int) -> Column:
    """[first block, second block, rest] -> [second, first, rest]."""
    v = col(vector)
    return F.concat(F.slice(v, first + 1, second), F.slice(v, 1, first), F.slice(v, first + second + 1, F.greatest(F.size(v) - first - second, F.lit(0))))


def add(a: Col, b: Col) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def subtract(a: Col, b: Col) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def scale(a: Col, k) -> Column:
    return F.transform(col(a), lambda x: x * k)


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Col) -> Column:
    return F.sqrt(dot(a, a))


def total(a: Col) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def pad_right(vector: Col, width: int, value: float = 0.0) -> Column:
    """Exactly ``width`` components: cut or filled with ``value``."""
    return F.slice(F.concat(col(vector), F.array_repeat(F.lit(value), width)), 1, width)  # the vector is computed once


def pad_mask(vector: Col, width: int) -> Column:
    """True where :func:`pad_right` filled in."""
    n = F.size(col(vector))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= n)


def split_parts(vector: Col, widths: Sequence[int]) -> list[Column]:
    """Consecutive parts of the given widths."""
    out, at = [], 0
    for w in widths:
        out.append(part(vector, at, w))
        at += w
    return out


def part_offsets(widths: Sequence[int]) -> list[tuple[int, int]]:
    """(start, end) of consecutive parts."""
    out, at = [], 0
    for w in widths:
        out.append((at, at + w))
        at += w
    return out


def running_sum(vector: Col) -> Column:
    """Prefix sums of a vector."""
    v = col(vector)
    return F.transform(v, lambda _, i: F.aggregate(F.slice(v, 1, i + 1), F.lit(0.0), lambda s, x: s + x))


def chunk_delta(chunk: Col, state: Col) -> Column:
    """First step minus the state, then each step minus the one before, for a chunk of scalars."""
    c = col(chunk)
    return F.zip_with(c, F.concat(F.array(col(state)), F.slice(c, 1, F.size(c) - 1)), lambda a, b: a - b)


def chunk_undelta(delta: Col, state: Col) -> Column:
    """The inverse of :func:`chunk_delta`."""
    return F.transform(running_sum(delta), lambda x: x + col(state))


def fixed_chunks(vector: Col, width: int) -> Column:
    """Pieces of ``width`` components, the last filled with zeros."""
    v = col(vector)
    pieces = F.ceil(F.size(v) / F.lit(width)).cast("int")
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: pad_right(F.slice(v, i * width + 1, width), width))).otherwise(F.array().cast("array<array<double>>"))


def unchunk(pieces: Col, width: int) -> Column:
    """The inverse of :func:`fixed_chunks` for a vector of ``width`` components."""
    return F.slice(F.flatten(col(pieces)), 1, width)


def bad_values(vector: Col) -> Column:
    """How many components are null, NaN or infinite."""
    return F.size(F.filter(col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def approx_index(values: Col, x: Column, tolerance: float = 1e-6) -> Column:
    """0-based place of the first component within ``tolerance`` of x, or -1."""
    return (F.array_position(F.transform(col(values), lambda v: F.abs(v - x) < tolerance), True) - 1).cast("int")


def left_aligned(values: Col, mask: Col) -> Column:
    """Components whose mask is true first, the others after them, each in order."""
    pairs = F.arrays_zip(col(values).alias("v"), col(mask).alias("m"))
    return F.concat(F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"]), F.transform(F.filter(pairs, lambda p: ~p["m"]), lambda p: p["v"]))


def keep_suffix(prefix: Col, suffix: Col, width: int) -> Column:
    """``prefix`` cut so that prefix and whole suffix fit into ``width``."""
    p, s = col(prefix), col(suffix)
    return F.concat(F.slice(p, 1, F.greatest(F.lit(0), F.least(F.size(p), F.lit(width) - F.size(s)))), F.slice(s, 1, width))
