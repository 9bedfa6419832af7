"""Action chunks as tokens and back: keys are parted into learned and rule keys, learned ones cut to one width and coded by residual codebooks, rule ones by constrained bit sequences, and all serialised behind markers.

Codebooks are model parameters of fixed size and travel with the kernels (:mod:`epiframe.functions.kernels`).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions import kernels
from epiframe.functions import tokens as T

#: A codebook: its entries, each of chunk width times segment length components, time by time.
Book = Sequence[Sequence[float]]


def parted(keys: Sequence[str], rule_pattern: str) -> tuple[list[str], list[str]]:
    """(learned, rule) keys: rule keys are those that the pattern finds."""
    rules = [k for k in keys if re.search(rule_pattern, k)]
    return [k for k in keys if k not in rules], rules


@dataclass(frozen=True)
class ActionCodec:
    """``dims``: key -> components of a step, in order; ``steps`` of a chunk; learned keys are cut to ``width`` and to segments of ``segment`` steps, coded by ``books``; rule keys have one component."""

    dims: dict[str, int]
    rule_pattern: str
    steps: int
    width: int
    segment: int
    books: Sequence[Book]
    shortest: int = 1
    threshold: float = 0.0

    @property
    def book_size(self) -> int:
        return max(len(b) for b in self.books)

    @property
    def bits(self) -> T.RunColumns:
        return T.RunColumns(self.steps, self.shortest, self.book_size)

    def _layout(self) -> tuple:
        return self.width, self.segment, self.books

    def keys(self) -> tuple[list[str], list[str]]:
        return parted(list(self.dims), self.rule_pattern)

    def chunk_names(self, key: str) -> list[str]:
        n = -(-self.dims[key] // self.width)
        return [key] if n == 1 else [f"{key}__chunk_{i}" for i in range(n)]

    def groups(self) -> list[T.Group]:
        """Markers follow the codes of a book."""
        learned, rules = self.keys()
        return T.marked_groups([c for k in learned for c in self.chunk_names(k)], rules, len(self.books), self.steps // self.segment, self.bits.digits, self.book_size)

    def codes(self, parts: dict[str, Column]) -> list[Column]:
        """Codes of each group, in the order of :meth:`groups`."""
        learned, rules = self.keys()
        by_name = {}
        for k in learned:
            coded = kernels.residual_coder(self.steps, self.dims[k], *self._layout())(parts[k].cast("array<array<double>>"))
            by_name |= {name: F.get(coded, F.lit(i)) for i, name in enumerate(self.chunk_names(k))}
        out = [F.get(by_name[g.key], F.lit(g.level)) for g in self.groups() if g.level >= 0]
        binary = lambda k: F.transform(parts[k], lambda row: (F.get(row, F.lit(0)) > self.threshold).cast("int"))
        return out + [self.bits.encode(binary(k)) for k in rules]

    def encode(self, parts: dict[str, Column], skip: Column | None = None, shuffle: Column | None = None) -> Column:
        return T.serialize_marked(self.groups(), self.codes(parts), skip, shuffle)

    def decode(self, parsed: Column) -> dict[str, Column]:
        """Chunks of each key from :func:`epiframe.functions.tokens.parse_marked`; learned ones are sums of entries, rule ones -1 or 1; null where a key does not occur."""
        learned, rules = self.keys()
        groups, out = self.groups(), {}
        for k in learned:
            levels = [T.learned_levels(parsed, groups, name) for name in self.chunk_names(k)]
            out[k] = kernels.residual_decoder(self.steps, self.dims[k], *self._layout())(*levels)
        for k in rules:
            digits = F.get(parsed, F.lit(next(i for i, g in enumerate(groups) if g.key == k)))
            out[k] = F.when(digits.isNotNull(), F.transform(self.bits.decode(digits), lambda b: F.array(F.when(b == 1, 1.0).otherwise(-1.0))))
        return out
