"""Text of annotations: bilingual instructions, plans, boxes, traces, spans, templates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.operators.selection import hashed_uniform

GRID = 1024


def language_side(text: Column, english: bool, whole: bool = False) -> Column:
    """A side of ``first@second``; texts without the mark are both sides.  ``whole``: everything after the first mark."""
    parts = F.split(text, "@", 2 if whole else -1)
    return F.when(text.contains("@"), F.element_at(parts, 2 if english else 1)).otherwise(text)


def high_low(high: Column, low: Column, drop: float, key: Column, seed: int = 0) -> Column:
    """``[High]: .., [Low]: ..``, without its low part for a repeatable share ``drop`` of keys."""
    full = F.concat(F.lit("[High]: "), high, F.lit(", [Low]: "), low)
    return F.when(hashed_uniform(key, seed=seed) < drop, F.concat(F.lit("[High]: "), high)).otherwise(full)


def split_plan(text: Column, mark: str = "[PLAN]") -> tuple[Column, Column]:
    """(task, plan) around the first mark, trimmed; the plan is null without a mark."""
    at = F.instr(text, mark)
    task = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    plan = F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))
    white = r"^\s+|\s+$"
    return F.regexp_replace(task, white, ""), F.regexp_replace(plan, white, "")


def plan_step(plan: Column, number: Column) -> Column:
    """The first line that starts with ``n.``, trimmed; null if none does."""
    lines = F.transform(F.split(plan, "\n"), lambda x: F.trim(x))  # F.trim itself would take the index as characters to trim
    return F.try_element_at(F.filter(lines, lambda x: x.startswith(F.concat(number.cast("string"), F.lit(".")))), F.lit(1))


def loc(value: Column, rounded: bool = True) -> Column:
    """``<locNNNN>`` of a coordinate in 0..1, rounded half to even or cut."""
    scaled = F.bround(value * GRID) if rounded else F.floor(value * GRID)
    return F.concat(F.lit("<loc"), F.lpad(F.greatest(F.lit(0), F.least(scaled, F.lit(GRID - 1))).cast("int").cast("string"), 4, "0"), F.lit(">"))


def boxes_text(payload: Column) -> Column:
    """``BBox: name <y1><x1><y2><x2>; ...`` of a JSON object of boxes; entries without four numbers are left out, null if no other is there."""
    entries = F.filter(F.map_entries(F.from_json(payload, "map<string,array<double>>")), lambda b: F.size(b["value"]) == 4)
    one = lambda b: F.concat(b["key"], F.lit(" "), *(loc(F.element_at(b["value"], i)) for i in (2, 1, 4, 3)))
    return F.when(F.size(entries) > 0, F.concat(F.lit("BBox: "), F.array_join(F.transform(entries, one), "; ")))


TRACE = "struct<uv_left:array<double>,visb_left:boolean,uv_right:array<double>,visb_right:boolean>"


def trace_text(payload: Column) -> Column:
    """``Trace: Left <loc><loc>; Right None``; null if no arm is visible."""
    t = F.from_json(payload, TRACE)
    side = lambda uv, seen: F.when(seen & uv.isNotNull(), F.concat(loc(F.element_at(uv, 1)), loc(F.element_at(uv, 2)))).otherwise("None")
    visible = (F.coalesce(t["visb_left"], F.lit(False)) & t["uv_left"].isNotNull()) | (F.coalesce(t["visb_right"], F.lit(False)) & t["uv_right"].isNotNull())
    return F.when(visible, F.concat(F.lit("Trace: Left "), side(t["uv_left"], t["visb_left"]), F.lit("; Right "), side(t["uv_right"], t["visb_right"])))


def parse_boxes(text: Column) -> Column:
    """Boxes (y1, x1, y2, x2) in 0..1 of four location tokens each; inverted sides are swapped, flat boxes null."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"<loc(\d{4})>"), 1), lambda x: x.cast("double") / GRID)
    count = F.floor(F.size(numbers) / 4).cast("int")
    at = lambda i, k: F.element_at(numbers, i * 4 + k)
    box = lambda i: F.array(F.least(at(i, 1), at(i, 3)), F.least(at(i, 2), at(i, 4)), F.greatest(at(i, 1), at(i, 3)), F.greatest(at(i, 2), at(i, 4)))
    flat = lambda b: (F.element_at(b, 1) == F.element_at(b, 3)) | (F.element_at(b, 2) == F.element_at(b, 4))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(~flat(box(i)), box(i)))).otherwise(F.array().cast("array<array<double>>"))


def coordinates_to_loc(text: Column) -> Column:
    """Bracketed coordinate lists such as ``[0.1, 0.2]`` as location tokens, values cut and not rounded."""
    found = F.regexp_extract_all(text, F.lit(r"\[\s*[0-9.]+(?:\s*,\s*[0-9.]+)*\s*\]"), 0)
    one = lambda b: F.array_join(F.transform(F.regexp_extract_all(b, F.lit(r"[0-9.]+"), 0), lambda x: loc(x.cast("double"), rounded=False)), "")
    return F.aggregate(F.transform(found, lambda b: F.struct(b.alias("b"), one(b).alias("t"))), text, lambda s, x: F.replace(s, x["b"], x["t"]))


def resolve_tokens(text: Column, names: dict[str, str]) -> Column:
    """Named tokens replaced by their spelling."""
    for k, v in names.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def split_tags(text: Column, tags: Sequence[str]) -> Column:
    """Map of tag to what follows it, up to the next tag, in any order; of a repeated tag the first counts."""
    every = "|".join(re.escape(t) for t in tags)
    after = lambda t: F.trim(F.regexp_extract(text, rf"(?s){re.escape(t)}(.*?)(?:{every}|\z)", 1))
    pairs = F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*(F.when(text.contains(t), after(t)) for t in tags)))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def points_text(name: Column, points: Column) -> Column:
    """Point text; a negative coordinate means that it can't be seen."""
    hidden = F.exists(points, lambda x: x < 0)
    return F.when(hidden, F.concat(name, F.lit(": Not visible"))).otherwise(F.concat(name, F.lit(": "), F.array_join(F.transform(points, lambda x: loc(x)), "")))


def clean_display(text: Column) -> Column:
    """Reasoning text without markers in angle brackets or pipes, white space joined."""
    out = F.regexp_replace(text, r"<loc\d{4}>|<[A-Z]{3}>|\|", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def action_span(text: Column) -> Column:
    """What follows ``Action: `` up to the next pipe, else null."""
    return F.when(text.contains("Action: "), F.element_at(F.split(F.element_at(F.split(text, "Action: ", 2), 2), r"\|", 2), 1))


def tag_instruction(text: Column) -> Column:
    """``[Low]: `` in front unless tagged; tags in one spelling; reset and stop as they are; empty and "nothing" give null."""
    t = F.trim(text)
    plain = F.lower(t)
    tagged = F.regexp_replace(F.regexp_replace(t, r"(?i)^\[low\]", "[Low]"), r"(?i)^\[high\]", "[High]")
    return F.when(t.isNull() | plain.isin("", "nothing"), None).when(plain.isin("reset", "stop"), t).when(plain.startswith("[low]") | plain.startswith("[high]"), tagged).otherwise(F.concat(F.lit("[Low]: "), t))


def valid_reasoning(text: Column, least: int = 3) -> Column:
    """Whether a text has a letter, enough words and does not say one word twice running."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    twice = F.exists(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return text.rlike("[A-Za-z]") & (F.size(words) >= least) & ~twice


def serialize_groups(groups: Sequence[tuple[int, Column, Column]]) -> Column:
    """Marker and codes of each group that is not skipped: [(marker, codes, skip)]."""
    return F.flatten(F.array(*(F.when(skip, F.array().cast("array<bigint>")).otherwise(F.concat(F.array(F.lit(marker).cast("long")), codes)) for marker, codes, skip in groups)))


PLACEHOLDER = re.compile(r"<([a-z][a-z0-9_]*?)(!)?(?:_(\d+))?>")


def parse_template(template: str, stop: str = "<EOC>") -> list[tuple[str, bool, int | None]]:
    """(name, must be trained, number) of the placeholders of a template; at most one ``stop`` tag."""
    if template.count(stop) > 1:
        raise ValueError(f"more than one {stop}")
    return [(m[1], bool(m[2]), int(m[3]) if m[3] else None) for m in PLACEHOLDER.finditer(template)]


def weighted_choice(applicable: Sequence[Column], weights: Sequence[float], u: Column) -> Column:
    """Number of the candidate that a uniform ``u`` picks among the applicable ones by weight; null if none is."""
    w = [F.when(a, float(x)).otherwise(0.0) for a, x in zip(applicable, weights)]
    total = sum(w[1:], w[0])
    out, run = F.lit(None).cast("int"), F.lit(0.0)
    ends = []
    for x in w:
        run = run + x
        ends.append(run)
    for i in range(len(w) - 1, -1, -1):
        out = F.when((w[i] > 0) & (u * total < ends[i]), i).otherwise(out)
    return F.when(total > 0, out)


def last_number(text: Column) -> Column:
    """The last line of a text that is a number."""
    numbers = F.filter(F.transform(F.split(text, "\n"), lambda x: F.try_to_number(F.trim(x), F.lit("S999999999.999999")).cast("double")), lambda x: x.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def key_values(text: Column) -> Column:
    """Map of ``key=value`` pairs between commas."""
    return F.str_to_map(text, F.lit(","), F.lit("="))
