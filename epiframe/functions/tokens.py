"""Token sequences as columns: constrained bit sequences, marked groups of codes, blocks, and modality pieces.

Sequences are put together by column expressions with the layout as a literal; what goes through
a sequence token by token is a numpy kernel over Arrow batches (:mod:`epiframe.functions.kernels`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions import kernels
from epiframe.functions.codes import RunCodec

#: The role of a token in a sequence, and the label of a token that is not trained.
PADDING, IMAGE, PROPRIO, ACTION, TEXT, COT, PREDICTED_TEXT = range(7)
IGNORED = -100

_LONGS = "array<bigint>"


def _bound(x: Column, function) -> Column:
    """``function(x)`` with x computed once."""
    return F.get(F.transform(F.array(x), function), F.lit(0))


def _longs(values: Sequence[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values)) if values else F.array().cast(_LONGS)


# --- constrained bit sequences ---------------------------------------------


class RunColumns:
    """:class:`epiframe.functions.codes.RunCodec` over columns of bit arrays: validity, repair, ranks in base-``base`` digits and back.

    Ranks are 64 bits wide, or Python's integers where those do not do.  A codec whose ranks times its base need more than 38
    digits raises.  Null bits count as 0.
    """

    def __init__(self, length: int, shortest: int, base: int):
        self.codec = RunCodec(length, shortest, base)
        self.length, self.shortest, self.base, self.digits, self.total = length, shortest, base, self.codec.digits, self.codec.total
        most = max(self.total, 1) * base
        if most >= 10**38:
            raise ValueError(f"ranks of {self.total} need more than 38 digits")
        self.kind = "long" if most < 2**63 else "decimal(38,0)"

    def _layout(self) -> tuple:
        return self.codec, self.length, self.shortest, self.base, int if self.kind == "long" else object

    def valid(self, bits: Column) -> Column:
        """Whether all runs but the first and the last are longer than ``shortest``."""
        return kernels.bits_valid(self.shortest)(bits)

    def repair(self, bits: Column) -> Column:
        """Inner runs that are too short take the value of the run on their left, from the left on, until none is."""
        return kernels.bits_repair(self.shortest)(bits)

    def encode(self, bits: Column) -> Column:
        """Digits of the repaired sequence's rank, the most significant first."""
        return kernels.bits_coder(*self._layout())(bits)

    def decode(self, digits: Column) -> Column:
        """The sequence of a rank given in digits; digits are clamped to the base, and ranks past the last count as the last."""
        return kernels.bits_decoder(*self._layout())(digits.cast(_LONGS))


# --- marked groups ---------------------------------------------------------


@dataclass(frozen=True)
class Group:
    """A run of ``width`` codes behind its marker token; ``level`` is that of a learned key's residual, -1 for a rule key."""

    key: str
    level: int
    marker: int
    width: int

    @property
    def name(self) -> str:
        return self.key if self.level < 0 else f"{self.key}_{self.level}"


def marked_groups(learned: Sequence[str], rules: Sequence[str], levels: int, code_len: int, rule_len: int, first_marker: int) -> list[Group]:
    """Level by level all learned keys, then the rule keys; markers are numbered from ``first_marker``, behind the codes."""
    spec = [(k, n, code_len) for n in range(levels) for k in learned] + [(k, -1, rule_len) for k in rules]
    return [Group(k, n, first_marker + i, w) for i, (k, n, w) in enumerate(spec)]


def _placed(tokens: Column, shuffle: Column | None, key: str, level: Column) -> Column:
    """Tokens, or none where they are null; with ``shuffle`` in a struct behind their place in a row's own order."""
    tokens = F.coalesce(tokens, _longs([]))
    return tokens if shuffle is None else F.struct(level.alias("level"), F.xxhash64(shuffle, F.lit(key)).alias("place"), tokens.alias("tokens"))


def _in_order(pieces: Sequence[Column], shuffle: Column | None) -> Column:
    """Pieces of :func:`_placed` one behind the other."""
    return F.concat(*pieces) if shuffle is None else F.flatten(F.sort_array(F.array(*pieces))["tokens"])


def serialize_marked(groups: Sequence[Group], codes: Sequence[Column], skip: Column | None = None, shuffle: Column | None = None) -> Column:
    """Marker and codes of each group in the order of the groups.

    Groups whose key is in the array ``skip``, or whose codes are null, are left out.  With ``shuffle`` (a column that
    seeds a row's order) keys are put in an order of the row's own, the same on every level, and rule keys stay last.
    """
    last = max((g.level for g in groups), default=-1) + 1
    pieces = []
    for g, c in zip(groups, codes):
        tokens = F.concat(_longs([g.marker]), c.cast(_LONGS))  # null where the codes are
        if skip is not None:
            tokens = F.when(~F.coalesce(F.array_contains(skip, g.key), F.lit(False)), tokens)
        level = F.lit(g.level if g.level >= 0 else last)
        pieces.append(_placed(tokens, shuffle, g.key, level))
    return _in_order(pieces, shuffle)


def parse_marked(tokens: Column, groups: Sequence[Group]) -> Column:
    """Codes of each group in the order of ``groups``, null where its marker does not occur.

    A known marker opens its group, which takes the tokens behind it, whatever they are, until it has its
    width; other tokens outside a group are skipped, a group cut short is filled with zeros, and of a repeated marker
    the last group counts.
    """
    if not groups:
        return F.transform(F.slice(tokens.cast(_LONGS), 1, 0), lambda _: F.lit(None).cast(_LONGS))
    return kernels.groups_parser([g.marker for g in groups], [g.width for g in groups])(tokens.cast(_LONGS))


def learned_levels(parsed: Column, groups: Sequence[Group], key: str) -> Column:
    """A learned key's codes by level: zeros for levels that are missing, null where all are."""
    at = [(i, g.width) for i, g in enumerate(groups) if g.key == key and g.level >= 0]
    zeros = F.array(*(F.coalesce(F.get(parsed, F.lit(i)), F.array_repeat(F.lit(0).cast("long"), w)) for i, w in at))
    return F.when(F.coalesce(*(F.get(parsed, F.lit(i)) for i, _ in at)).isNotNull(), zeros)


def without_markers(tokens: Column, groups: Sequence[Group]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*(g.marker for g in groups)))


@dataclass(frozen=True)
class SignedPart:
    """A part of a body whose codes (level by level, block by block) each block of ``width`` has a sign token before."""

    name: str
    signs: tuple[int, ...]
    levels: int
    width: int

    @property
    def blocks(self) -> int:
        """Blocks of a level."""
        return len(self.signs) // self.levels


def serialize_signed(parts: Sequence[SignedPart], codes: Sequence[Column], shuffle: Column | None = None, first: Sequence[str] = ()) -> Column:
    """Level by level the signed blocks of each part that is not null, parts in the order given, ``first`` ones before, or in a row's own order by ``shuffle``."""
    ranked = sorted(range(len(parts)), key=lambda i: (first.index(parts[i].name) if parts[i].name in first else len(first), i))
    levels = []
    for n in range(max(p.levels for p in parts)):
        rows = []
        for i in ranked:
            p, c = parts[i], codes[i].cast(_LONGS)
            if n < p.levels:
                blocks = [x for b in range(n * p.blocks, (n + 1) * p.blocks) for x in (_longs([p.signs[b]]), F.slice(c, b * p.width + 1, p.width))]
                rows.append(_placed(F.concat(*blocks), shuffle, p.name, F.lit(n)))
        levels.append(_in_order(rows, shuffle))
    return F.concat(*levels)


def parse_signed(tokens: Column, parts: Sequence[SignedPart]) -> Column:
    """Map of part to codes, in whatever order parts come; blocks that are missing are zeros, parts without any are left out."""
    groups = [Group(p.name, b, s, p.width) for p in parts for b, s in enumerate(p.signs)]

    parsed, none = parse_marked(tokens, groups), F.array().cast("array<struct<part:string,codes:array<bigint>>>")
    whole = [(F.lit(p.name), F.flatten(learned_levels(parsed, groups, p.name))) for p in parts]
    return F.map_from_entries(F.concat(*(F.when(v.isNotNull(), F.array(F.struct(k.alias("part"), v.alias("codes")))).otherwise(none) for k, v in whole)))


def with_indicators(tokens: Column, order: Column, indicators: dict[str, int], separator: int) -> Column:
    """A token for each part named in ``order``, the separator, then the tokens."""
    names = F.create_map(*(x for k, v in indicators.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    return F.concat(F.transform(order, lambda k: names[k]), _longs([separator]), tokens.cast(_LONGS))


def without_indicators(tokens: Column, separator: int) -> Column:
    """What follows the first separator; all tokens where there is none."""
    at = F.array_position(tokens, F.lit(separator).cast("long")).cast("int")
    return F.when(at > 0, F.slice(tokens, at + 1, F.size(tokens))).otherwise(tokens)


# --- blocks and pieces -----------------------------------------------------


def piece(ids: Column, labels: Column, tags: Column) -> Column:
    return F.struct(ids.cast(_LONGS).alias("ids"), labels.cast(_LONGS).alias("labels"), tags.cast("array<double>").alias("tags"))


def _same(ids: Column, value: float) -> Column:
    return F.transform(ids, lambda _: F.lit(value))


def joined(pieces: Sequence[Column]) -> Column:
    """Pieces one behind the other."""
    return F.struct(*(F.concat(*(p[name] for p in pieces)).alias(name) for name in ("ids", "labels", "tags")))


def text_piece(ids: Column, masked: Column) -> Column:
    """Text that is given (masked: not trained) or to be predicted."""
    return piece(ids, F.when(masked, _same(ids, IGNORED)).otherwise(ids.cast("array<int>")), F.when(masked, _same(ids, TEXT)).otherwise(_same(ids, PREDICTED_TEXT)))


def image_piece(height: Column, width: Column, patch: int, merge: int, image: int, begin: int, end: int) -> Column:
    """Begin, a token for each merged patch of an image, end."""
    side = lambda x: F.floor(F.floor(x / patch) / merge).cast("int")
    patches = F.array_repeat(F.lit(image), side(height) * side(width))
    ids = F.concat(F.array(F.lit(begin)), patches, F.array(F.lit(end)))
    tags = F.concat(F.array(F.lit(TEXT)), _same(patches, IMAGE), F.array(F.lit(TEXT)))
    return piece(ids, _same(ids, IGNORED), tags)


def state_piece(steps: Column, token: int, dropped: Column | None = None) -> Column:
    """A placeholder for each step of state, never trained; none where the state is dropped."""
    ids = F.array_repeat(F.lit(token), steps if dropped is None else F.when(dropped, 0).otherwise(steps))
    return piece(ids, _same(ids, IGNORED), _same(ids, PROPRIO))


def bins_piece(ids: Column, masked: Column) -> Column:
    """State as tokens."""
    return piece(ids, F.when(masked, _same(ids, IGNORED)).otherwise(ids.cast("array<int>")), _same(ids, PROPRIO))


def block_piece(ids: Column, block: int, begin: int, end: int, pad: int, direct: int = 0, blocks: int | None = None, tag: float = ACTION) -> Column:
    """Tokens for block-wise prediction: inputs, labels one block ahead, and a tag for each block.

    The last block is padded; ``blocks`` cuts or pads to a number of them.  The first ``direct`` blocks are predicted token
    by token.  Then come a block of ``begin``, tagged a hundredth above, the other blocks, each a hundredth more, and
    one ``end``; labels have one ``begin`` there and a block of ``end`` behind.
    """

    def made(wide: Column) -> Column:
        n = F.ceil(F.size(wide) / block).cast("int") if blocks is None else F.lit(blocks)
        return F.slice(F.transform(F.sequence(F.lit(0), n * block), lambda i: F.coalesce(F.get(wide, i), F.lit(pad).cast("long"))), 1, n * block)

    def whole(filled: Column) -> Column:
        n = F.size(filled) / block
        now = F.least(n, F.lit(direct)).cast("int")
        head, rest = F.slice(filled, 1, now * block), F.slice(filled, now * block + 1, F.greatest(F.size(filled) - now * block, F.lit(0)))
        tags = F.transform(rest, lambda _, i: F.lit(float(tag)) + 0.01 * (F.floor(i / block) + 2))
        out = [
            (F.concat(head, _longs([begin] * block), rest, _longs([end])), head),
            (F.concat(head, _longs([begin]), rest, _longs([end] * block)), head),
            (F.concat(_same(head, float(tag)), F.array(*[F.lit(float(tag)) + 0.01] * block), tags, F.array(F.lit(float(tag)))), _same(head, float(tag))),
        ]
        return piece(*(F.when(F.size(rest) > 0, full).otherwise(only) for full, only in out))

    return _bound(_bound(ids.cast(_LONGS), made), whole)


def framed(block: Column, prefix: Sequence[int], suffix: Sequence[int], tag: float = ACTION) -> Column:
    """A piece between the tokens of its template, which are tagged and trained as it is."""
    ends = [piece(_longs(x), _longs(x), F.array(*(F.lit(float(tag)) for _ in x)).cast("array<double>")) for x in (prefix, suffix)]
    return joined([ends[0], block, ends[1]])
