"""Alignment of parts of different embodiments to one layout."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions.arrays import pad_right


@dataclass(frozen=True)
class Slot:
    """A place of the merged layout: the parts that may fill it, first present one wins, and its width."""

    name: str
    alternatives: tuple[str, ...]
    width: int


def layout(slots: Sequence[Slot]) -> dict[str, tuple[int, int]]:
    """(start, end) of each slot."""
    out, at = {}, 0
    for s in slots:
        out[s.name] = (at, at + s.width)
        at += s.width
    return out


def total_width(slots: Sequence[Slot]) -> int:
    return sum(s.width for s in slots)


def grouped_slots(groups: dict[str, Sequence[str]], widths: dict[str, int]) -> list[Slot]:
    """A slot per group, as wide as its widest alternative."""
    return [Slot(g, tuple(a), max(widths[x] for x in a)) for g, a in groups.items()]


def merge_widths(*embodiments: dict[str, int]) -> dict[str, int]:
    """Largest width of each part over embodiments, in order of first appearance."""
    out: dict[str, int] = {}
    for e in embodiments:
        for k, w in e.items():
            out[k] = max(out.get(k, 0), w)
    return out


def _present(parts: dict[str, Column], slot: Slot) -> list[str]:
    return [a for a in slot.alternatives if a in parts]


def merge(parts: dict[str, Column], slots: Sequence[Slot]) -> Column:
    """One vector: each slot's first non-null part, cut or padded with zeros; absent slots are zeros."""
    blocks = []
    for s in slots:
        here = _present(parts, s)
        empty = F.array_repeat(F.lit(0.0), s.width)
        blocks.append(F.coalesce(*(pad_right(parts[k], s.width) for k in here), empty) if here else empty)
    return F.concat(*blocks)


def merged_mask(parts: dict[str, Column], slots: Sequence[Slot]) -> Column:
    """True over slots that some part fills."""
    blocks = []
    for s in slots:
        here = _present(parts, s)
        filled = F.coalesce(*(F.when(parts[k].isNotNull(), True) for k in here), F.lit(False)) if here else F.lit(False)
        blocks.append(F.array_repeat(filled, s.width))
    return F.concat(*blocks)


def padded_dims(parts: dict[str, int], slots: Sequence[Slot]) -> list[bool]:
    """Which dimensions of the layout no part of these widths reaches."""
    out: list[bool] = []
    for s in slots:
        here = _present({k: F.lit(0) for k in parts}, s)
        width = min(parts[here[0]], s.width) if here else 0
        out += [i >= width for i in range(s.width)]
    return out


def split(merged: Column, slots: Sequence[Slot], widths: dict[str, int]) -> dict[str, Column]:
    """The inverse of :func:`merge` for the first part of each slot that an embodiment has."""
    out = {}
    for s, (start, _) in zip(slots, layout(slots).values()):
        if here := [a for a in s.alternatives if a in widths]:
            out[here[0]] = F.slice(merged, start + 1, min(widths[here[0]], s.width))
    return out


@dataclass(frozen=True)
class Aligned:
    """A part brought to a width: its chunk, which of its dimensions are operated, and which were filled in."""

    chunk: Column
    operated: Column
    padded: Column


def aligned(parts: dict[str, Column], masks: dict[str, Column], widths: dict[str, int], steps: Column) -> dict[str, Aligned]:
    """Every key of ``widths`` as a chunk of that width.

    Narrower parts are filled with zeros, wider ones cut; their masks too, with false.  A part without a mask is operated in
    all dimensions, those filled in included.  A part that an embodiment does not have, or that is null, is virtual: zeros
    of ``steps`` steps, operated nowhere, and filled in everywhere.
    """
    out = {}
    for k, width in widths.items():
        zeros = F.transform(F.sequence(F.lit(0), steps), lambda _: F.array_repeat(F.lit(0.0), width))
        zeros, none, every = F.slice(zeros, 1, steps), F.array_repeat(F.lit(False), width), F.array_repeat(F.lit(True), width)
        if k not in parts:
            out[k] = Aligned(zeros, none, every)
            continue
        chunk = parts[k]
        mask = F.slice(F.concat(masks[k], none), 1, width) if k in masks else every
        own = F.size(F.get(chunk, F.lit(0)))
        filled = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i > own)
        here = chunk.isNotNull()
        out[k] = Aligned(
            F.when(here, _rows(chunk, lambda row: pad_right(row, width))).otherwise(zeros),
            F.when(here, F.coalesce(mask, every)).otherwise(none),
            F.when(here, filled).otherwise(every),
        )
    return out


def _rows(chunk: Column, of) -> Column:
    return F.transform(chunk, lambda row: of(row))


def concatenated(parts: dict[str, Aligned], steps: Column) -> Aligned:
    """All parts side by side."""
    chunks = [p.chunk for p in parts.values()]
    whole = F.slice(F.transform(F.sequence(F.lit(0), steps), lambda i: F.concat(*(F.coalesce(F.get(c, i), F.array().cast("array<double>")) for c in chunks))), 1, steps)
    return Aligned(whole, F.concat(*(p.operated for p in parts.values())), F.concat(*(p.padded for p in parts.values())))


def separated(chunk: Column, widths: dict[str, int], own: dict[str, int]) -> dict[str, Column]:
    """The inverse of :func:`concatenated` and :func:`aligned`: the parts an embodiment has, in their own widths."""
    out, at = {}, 0
    cut = lambda start, width: F.transform(chunk, lambda row: F.slice(row, start, width))
    for k, width in widths.items():
        if k in own:
            out[k] = cut(at + 1, min(width, own[k]))
        at += width
    return out


def pad_to(vector: Column, width: int) -> tuple[Column, Column]:
    """(vector of ``width``, mask that is true where padded)."""
    return pad_right(vector, width), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= F.size(vector))


def fill_absent(parts: Column, wanted: Sequence[tuple[str, int]]) -> Column:
    """A part map with zeros for absent parts."""
    return F.map_from_arrays(F.array(*(F.lit(k) for k, _ in wanted)), F.array(*(F.coalesce(F.try_element_at(parts, F.lit(k)), F.array_repeat(F.lit(0.0), w)) for k, w in wanted)))


def drop_absent(parts: Column) -> Column:
    """A part map without null parts."""
    return F.map_filter(parts, lambda _, v: v.isNotNull())


def check_layout(spans: Sequence[tuple[int, int]], width: int) -> list[str]:
    """Problems of a flat layout: gaps, overlaps, wrong end."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append(f"gap {at}..{start}")
        if start < at:
            out.append(f"overlap at {start}")
        at = max(at, end)
    return out + ([f"ends at {at}, not {width}"] if at != width else [])
