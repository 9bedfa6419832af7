"""Invertible transforms of parts, as column expressions over chunks (ARRAY<ARRAY<DOUBLE>>) and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions.arrays import chunk_delta


class Transform(Protocol):
    """What a plug-in transform offers: columns in, columns out."""

    invertible: bool

    def forward(self, parts: dict[str, Column]) -> dict[str, Column]: ...

    def backward(self, parts: dict[str, Column]) -> dict[str, Column]: ...


@dataclass(frozen=True)
class Concat:
    """Several parts to one and back; absent parts are left out."""

    inputs: tuple[str, ...]
    widths: tuple[int, ...]
    output: str
    invertible: bool = True

    def forward(self, parts: dict[str, Column]) -> dict[str, Column]:
        here = [parts[k] for k in self.inputs if k in parts]
        rest = {k: v for k, v in parts.items() if k not in self.inputs}
        return rest | ({self.output: F.concat(*here)} if here else {})

    def backward(self, parts: dict[str, Column]) -> dict[str, Column]:
        out, at = {k: v for k, v in parts.items() if k != self.output}, 1
        for k, w in zip(self.inputs, self.widths):
            out[k] = F.slice(parts[self.output], at, w)
            at += w
        return out


@dataclass(frozen=True)
class RelativeJoint:
    """Chunk steps less the last state, of all dimensions or the listed ones; parts without a state stay as they are."""

    keys: tuple[str, ...]
    states: dict[str, Column]
    dims: tuple[int, ...] | None = None
    invertible: bool = True

    def _apply(self, parts: dict[str, Column], sign: int) -> dict[str, Column]:
        out = dict(parts)
        for k in self.keys:
            if k in parts and k in self.states:
                out[k] = relative(parts[k], self.states[k], sign, self.dims)
        return out

    def forward(self, parts: dict[str, Column]) -> dict[str, Column]:
        return self._apply(parts, -1)

    def backward(self, parts: dict[str, Column]) -> dict[str, Column]:
        return self._apply(parts, 1)


@dataclass(frozen=True)
class EachPart:
    """A column function on each of some parts, with its inverse if it has one."""

    keys: tuple[str, ...]
    to: Callable[[Column], Column]
    back: Callable[[Column], Column] | None = None

    @property
    def invertible(self) -> bool:
        return self.back is not None

    def forward(self, parts: dict[str, Column]) -> dict[str, Column]:
        return {k: self.to(v) if k in self.keys else v for k, v in parts.items()}

    def backward(self, parts: dict[str, Column]) -> dict[str, Column]:
        return {k: self.back(v) if self.back and k in self.keys else v for k, v in parts.items()}


@dataclass(frozen=True)
class Composite:
    """Transforms one after another; backward goes through those that can be inverted, last first."""

    steps: tuple

    @property
    def invertible(self) -> bool:
        return all(s.invertible for s in self.steps)

    def forward(self, parts: dict[str, Column]) -> dict[str, Column]:
        for s in self.steps:
            parts = s.forward(parts)
        return parts

    def backward(self, parts: dict[str, Column]) -> dict[str, Column]:
        for s in reversed(self.steps):
            parts = s.backward(parts) if s.invertible else parts
        return parts


def observation_tolerance(fps: float) -> float:
    """Seconds by which an observation may miss its time: 0.4 of a frame."""
    return 0.4 / fps


def relative(chunk: Column, state: Column, sign: int = -1, dims: Sequence[int] | None = None) -> Column:
    """Each step of a chunk of vectors plus ``sign`` times the state."""
    if dims is None:
        return F.transform(chunk, lambda row: F.zip_with(row, state, lambda x, s: x + sign * s))
    return F.transform(chunk, lambda row: F.transform(row, lambda x, i: F.when(i.isin(*dims), x + sign * F.element_at(state, i + 1)).otherwise(x)))


def wrap_angle(x: Column) -> Column:
    """The same angle in (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def binarize(x: Column, threshold: float, high: float = 1.0, low: float = 0.0) -> Column:
    """High strictly above the threshold."""
    return F.when(x > threshold, high).otherwise(low)


def client_binarize(x: Column, threshold: float) -> Column:
    """100 from the threshold on, else 0."""
    return F.when(x >= threshold, 100.0).otherwise(0.0)


def asinh_compress(x: Column, bound: float) -> Column:
    return F.asinh(x / (1.5 * bound))


def asinh_expand(y: Column, bound: float) -> Column:
    return 1.5 * bound * F.sinh(y)


def gripper_unit(width: Column, most: float) -> Column:
    return 2 * (width / most) - 1


def affine_unit(x: Column, sign: float, scale: float, offset: float) -> Column:
    return sign * scale * x + offset


def affine_unit_inverse(y: Column, sign: float, scale: float, offset: float) -> Column:
    return (y - offset) / (sign * scale)


def step_limited(current: Column, target: Column, most: float) -> Column:
    """The target, pulled toward the current vector so that no component moves by more than ``most``."""
    delta = F.zip_with(target, current, lambda t, c: t - c)
    peak = F.array_max(F.transform(delta, F.abs))
    k = F.when(peak > most, most / peak).otherwise(1.0)
    return F.zip_with(current, delta, lambda c, x: c + x * k)


def ema(values: Column, alpha: float) -> Column:
    """Final value of the exponential moving average of an ordered array, from its first."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda p, x: (1 - alpha) * p + alpha * x)


def flip_gripper(x: Column) -> Column:
    return 1 - x


def velocity(chunk: Column, current: Column, seconds: float = 0.2) -> Column:
    """Differences of a scalar chunk from the current value on, per second."""
    return F.transform(chunk_delta(chunk, current), lambda x: x / seconds)


def smart_size(height: Column, width: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """A target size in multiples of ``factor`` whose area lies within [least, most], about the same shape."""
    h, w = F.greatest(F.lit(factor), F.bround(height / factor) * factor), F.greatest(F.lit(factor), F.bround(width / factor) * factor)
    shrink, grow = F.sqrt(height * width / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (height * width))
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor)
    up = lambda x: F.ceil(x * grow / factor) * factor
    pick = lambda base, x: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(base).cast("long")
    return pick(h, height), pick(w, width)


def centre_crop(height: Column, width: Column, share: float) -> tuple[Column, Column, Column, Column]:
    """(top, left, height, width) of the centred box of a share of both sides."""
    h, w = F.floor(height * share), F.floor(width * share)
    return F.floor((height - h) / 2), F.floor((width - w) / 2), h, w


def linear_schedule(step: Column, start: float, end: float, steps: int) -> Column:
    """Linear from start to end, held after ``steps``."""
    return start + (end - start) * F.least(F.greatest(step / F.lit(float(steps)), F.lit(0.0)), F.lit(1.0))


def cosine_schedule(step: Column, peak: float, floor: float, warmup: int, constant: int, total: int) -> Column:
    """Linear warm-up, a constant stretch, then a half cosine down to the floor."""
    after = F.least((step - warmup - constant) / F.lit(float(max(1, total - warmup - constant))), F.lit(1.0))
    return F.when(step < warmup, peak * step / max(1, warmup)).when(step < warmup + constant, F.lit(peak)).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * after)))
