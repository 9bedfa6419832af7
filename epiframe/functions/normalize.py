"""Normalisation of components against statistics, and its inverse, as column expressions.

Modes: ``identity`` (clamp to the range forward, nothing back), ``min/max``, any
``qLOW/qHIGH`` pair, ``z-score``, the tail-compressed ``z-score-tail`` and
``q01/q99-tail``, ``tanh`` and constant ranges ``"lo/hi"``.

Statistics are columns: scalars for :func:`forward` and :func:`backward`, arrays over
dimensions for :func:`vector`, arrays over steps of arrays over dimensions for
:func:`chunk`.  Dimensions beyond the statistics pass through; statistics of more
steps than a chunk has are cut, of fewer raise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT = 1e-4
LIMIT = 5.0
TAIL = 0.075


@dataclass(frozen=True)
class Stats:
    """Statistics of one component, or arrays of them; each a column.  ``quantiles`` by name: q01, q99, q001, ..."""

    min: Column
    max: Column
    mean: Column
    std: Column
    quantiles: Mapping[str, Column] = field(default_factory=dict)

    @property
    def q01(self) -> Column:
        return self.quantile("q01")

    @property
    def q99(self) -> Column:
        return self.quantile("q99")

    def quantile(self, name: str) -> Column:
        if name not in self.quantiles:
            raise KeyError(f"the statistics have no {name}")
        return self.quantiles[name]

    def map(self, f: Callable[[Column], Column]) -> Stats:
        return Stats(f(self.min), f(self.max), f(self.mean), f(self.std), {k: f(v) for k, v in self.quantiles.items()})

    def at(self, i: Column) -> Stats:
        """The statistics at a 0-based place of arrays."""
        return self.map(lambda c: F.get(c, i))

    @staticmethod
    def of(prefix: str = "", quantiles: tuple[str, ...] = ("q01", "q99")) -> Stats:
        return Stats(*(F.col(prefix + n) for n in ("min", "max", "mean", "std")), {q: F.col(prefix + q) for q in quantiles})

    @staticmethod
    def fixed(min: float, max: float, mean: float, std: float, q01: float, q99: float, **quantiles: float) -> Stats:
        return Stats(*(F.lit(float(x)) for x in (min, max, mean, std)), {k: F.lit(float(x)) for k, x in {"q01": q01, "q99": q99, **quantiles}.items()})


def _range(mode: str, s: Stats) -> tuple[Column, Column]:
    if mode in ("identity", "min/max", "tanh"):
        return s.min, s.max
    if mode.startswith("q"):
        low, high = mode.removesuffix("-tail").split("/")
        return s.quantile(low), s.quantile(high)
    low, high = mode.split("/")
    return F.lit(float(low)), F.lit(float(high))


def affine(mode: str, s: Stats) -> tuple[Column, Column]:
    """(scale, offset); ranges under FLAT and deviations under FLAT only shift."""
    if mode.startswith("z-score"):
        scale = F.when(s.std < FLAT, 1.0).otherwise(1 / (s.std + 1e-8))
        return scale, -s.mean * scale
    low, high = _range(mode, s)
    flat = high - low < FLAT
    scale = F.when(flat, 1.0).otherwise(F.try_divide(F.lit(2.0), high - low))
    return scale, F.when(flat, -low).otherwise(-1 - scale * low)


def _tails(s: Stats, strength: float) -> tuple[Column, Column]:
    plain = (s.q99 <= s.q01) | (s.mean <= s.q01) | (s.mean >= s.q99)
    return F.when(plain, 1.0).otherwise(strength * (s.q99 - s.mean)), F.when(plain, 1.0).otherwise(strength * (s.mean - s.q01))


def compress_tails(x: Column, s: Stats, strength: float = TAIL) -> Column:
    """log1p beyond [q01, q99]."""
    up, down = _tails(s, strength)
    return F.when(x > s.q99, s.q99 + up * F.log1p((x - s.q99) / up)).when(x < s.q01, s.q01 - down * F.log1p((s.q01 - x) / down)).otherwise(x)


def expand_tails(y: Column, s: Stats, strength: float = TAIL) -> Column:
    """The inverse of :func:`compress_tails`."""
    up, down = _tails(s, strength)
    return F.when(y > s.q99, s.q99 + up * F.expm1((y - s.q99) / up)).when(y < s.q01, s.q01 - down * F.expm1((s.q01 - y) / down)).otherwise(y)


def forward(x: Column, mode: str, s: Stats) -> Column:
    """The normalised component: NaN gives 0, infinities the limit."""
    if mode == "identity":
        return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.least(x, s.max), s.min))
    if mode.endswith("-tail"):
        x = compress_tails(x, s)
    scale, offset = affine(mode, s)
    y = x * scale + offset
    y = F.tanh(y) if mode == "tanh" else F.greatest(F.least(y, F.lit(LIMIT)), F.lit(-LIMIT))
    return F.when(F.isnan(x), 0.0).otherwise(y)


def lines(mode: str, s: Stats) -> Column:
    """:func:`affine` of each dimension of statistics that are arrays, for :func:`vector`; nulls for ``identity``, which has none."""
    if mode == "identity":
        return F.transform(s.mean, lambda _: F.struct(F.lit(None).cast("double").alias("scale"), F.lit(None).cast("double").alias("offset")))

    def line(_: Column, i: Column) -> Column:
        scale, offset = affine(mode, s.at(i))
        return F.struct(scale.alias("scale"), offset.alias("offset"))

    return F.transform(s.mean, line)


def backward(y: Column, mode: str, s: Stats, line: Column | None = None) -> Column:
    """The component from its normalised value, inside the limits; ``line`` is its scale and offset, if they are known."""
    if mode == "identity":
        return y
    if mode == "tanh":
        y = F.atanh(F.greatest(F.least(y, F.lit(1 - 1e-7)), F.lit(-1 + 1e-7)))
    scale, offset = affine(mode, s) if line is None else (line["scale"], line["offset"])
    x = (y - offset) / scale
    return expand_tails(x, s) if mode.endswith("-tail") else x


def vector(x: Column, mode: str, s: Stats, inverse: bool = False, lines: Column | None = None) -> Column:
    """A vector by statistics that are arrays over its dimensions; dimensions beyond them pass through.

    The way back takes scales and offsets from ``lines`` (:func:`lines`), so that many vectors share them.
    """
    line = lambda i: None if lines is None else F.get(lines, i)
    one = (lambda v, i: backward(v, mode, s.at(i), line(i))) if inverse else (lambda v, i: forward(v, mode, s.at(i)))
    return F.transform(x, lambda v, i: F.when(i < F.size(s.mean), one(v, i)).otherwise(v))


def chunk(x: Column, mode: str, s: Stats, inverse: bool = False) -> Column:
    """A chunk of vectors by stepwise statistics; those of later steps than it has are not used, too few raise."""
    one = backward if inverse else forward

    def step(row: Column, j: Column) -> Column:
        t = s.at(j)
        return F.transform(row, lambda v, i: F.when(i < F.size(t.mean), one(v, mode, t.at(i))).otherwise(v))

    short = F.raise_error(F.concat(F.lit("statistics of "), F.size(s.mean).cast("string"), F.lit(" steps for a chunk of "), F.size(x).cast("string")))
    return F.when(F.size(s.mean) >= F.size(x), F.transform(x, step)).otherwise(short.cast("array<array<double>>"))


def round_trip_error(x: Column, mode: str, s: Stats) -> Column:
    """How far a component is from itself after both ways."""
    return F.abs(backward(forward(x, mode, s), mode, s) - x)


def close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-5) -> Column:
    """Whether two components are equal up to the tolerances."""
    return F.abs(x - y) <= atol + rtol * F.abs(y)


@dataclass(frozen=True)
class Resolved:
    """How a part is normalised: its mode, whether by stepwise statistics, and whether results are clipped."""

    mode: str
    stepwise: bool
    clip: bool


def resolve(key: str, kind: str, default: str, modes: Mapping[str, str], unclipped: frozenset[str] | set[str], available: Mapping[str, set[str]], stepwise: bool, strict: bool = True) -> Resolved:
    """The normaliser of a part; ``available`` has its kinds of statistics ("global", "stepwise").

    States always take global statistics, actions stepwise ones if asked.  A part without the statistics that it needs
    raises if ``strict``, else it is ``identity``.
    """
    per_step = stepwise and kind == "action"
    mode = modes.get(key, default)
    if ("stepwise" if per_step else "global") not in available.get(key, set()):
        if strict and mode != "identity":
            raise KeyError(f"no {'stepwise' if per_step else 'global'} statistics for {key}")
        return Resolved("identity", False, False)
    return Resolved(mode, per_step, key not in unclipped)


def guard(x: Column, s: Stats, sigmas: float | None = None) -> Column:
    """Clip to [q01, q99], or pull to mean +- sigmas * std (a tiny std counts as 1)."""
    if sigmas is None:
        return F.greatest(F.least(x, s.q99), s.q01)
    std = F.when(s.std <= 1e-6, 1.0).otherwise(s.std)
    return F.greatest(F.least(x, s.mean + sigmas * std), s.mean - sigmas * std)
