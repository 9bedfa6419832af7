"""Declared schemas: raw features, parts drawn from them, and the Spark types they become."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.functions import arrays as A

#: Columns that every frame table has.
FRAME_COLUMNS = {"timestamp": T.DoubleType(), "frame_index": T.LongType(), "episode_index": T.LongType(), "index": T.LongType(), "task_index": T.LongType()}
#: Further index columns that a frame table may have.
OPTIONAL_COLUMNS = ("coarse_task_index", "coarse_quality_index", "quality_index")
SCALARS = {"float32": T.FloatType(), "float64": T.DoubleType(), "int64": T.LongType(), "int32": T.IntegerType(), "bool": T.BooleanType(), "string": T.StringType(), "image": T.BinaryType()}
MOST_RANK = 5


@dataclass(frozen=True)
class Feature:
    """A raw column: kind, shape and names of its components."""

    dtype: str
    shape: tuple[int, ...]
    names: tuple[str, ...] | None = None

    def spark_type(self) -> T.DataType | None:
        """None for video, which is not stored in the table."""
        if self.dtype == "video":
            return None
        if self.dtype in ("image", "string"):
            return SCALARS[self.dtype]
        if len(self.shape) > MOST_RANK:
            raise ValueError(f"rank {len(self.shape)} is above {MOST_RANK}")
        kind: T.DataType = SCALARS[self.dtype]
        if self.shape != (1,):
            for _ in self.shape:
                kind = T.ArrayType(kind)
        return kind


def table_schema(features: dict[str, Feature]) -> T.StructType:
    """Schema of a frame table; names may not hold a slash."""
    fields = [T.StructField(n, k) for n, k in FRAME_COLUMNS.items()]
    fields += [T.StructField(n, T.LongType()) for n in OPTIONAL_COLUMNS if n in features]
    for name, f in features.items():
        if "/" in name:
            raise ValueError(f"{name}: a feature name may not hold '/'")
        if name not in (*FRAME_COLUMNS, *OPTIONAL_COLUMNS) and (kind := f.spark_type()) is not None:
            fields.append(T.StructField(name, kind, metadata={"shape": list(f.shape)}))
    return T.StructType(fields)


def merge_features(*dicts: dict[str, Feature]) -> dict[str, Feature]:
    """Features of several sources: names of a shared vector are appended, images of later ones win, kinds must agree."""
    out: dict[str, Feature] = {}
    for d in dicts:
        for k, f in d.items():
            old = out.get(k)
            if old is None or f.dtype in ("image", "video"):
                out[k] = f
                continue
            if old.dtype != f.dtype:
                raise ValueError(f"{k}: {old.dtype} and {f.dtype}")
            if old.names is not None and f.names is not None:
                names = (*old.names, *(n for n in f.names if n not in old.names))
                out[k] = Feature(f.dtype, (len(names),), names)
    return out


def hardware_features(prefix: str, joints: Sequence[str], cameras: dict[str, tuple[int, ...]], video: bool = True) -> dict[str, Feature]:
    """A vector of named joints and one feature per camera."""
    out = {prefix: Feature("float32", (len(joints),), tuple(joints))} if joints else {}
    return out | {f"{prefix}.images.{c}": Feature("video" if video else "image", s, ("height", "width", "channels")) for c, s in cameras.items()}


@dataclass(frozen=True)
class Part:
    """A named part of a logical schema: slices of one or several raw columns, one after the other."""

    key: str
    columns: tuple[str, ...]
    starts: tuple[int, ...]
    widths: tuple[int, ...]
    time_offset: int = 0
    flip: bool = False

    def __post_init__(self):
        if not self.columns or len({len(self.columns), len(self.starts), len(self.widths)}) != 1:
            raise ValueError(f"{self.key}: columns, starts and widths must match")

    @property
    def width(self) -> int:
        return sum(self.widths)

    def column(self) -> Column:
        """The part as a vector of doubles; ``flip`` gives 1 - x."""
        v = A.join_parts(*(A.part(c, s, w) for c, s, w in zip(self.columns, self.starts, self.widths))).cast("array<double>")
        return F.transform(v, lambda x: 1 - x) if self.flip else v



def parts_from_config(entries: Iterable[dict]) -> list[Part]:
    """Parts of a declared schema; unknown and missing keys are errors."""
    known = {"key", "columns", "starts", "widths", "time_offset", "flip"}
    out = []
    for e in entries:
        if extra := set(e) - known:
            raise ValueError(f"unknown keys {sorted(extra)}")
        if missing := {"key", "columns", "widths"} - set(e):
            raise ValueError(f"missing keys {sorted(missing)}")
        columns = (e["columns"],) if isinstance(e["columns"], str) else tuple(e["columns"])
        widths = (e["widths"],) if isinstance(e["widths"], int) else tuple(e["widths"])
        starts = e.get("starts", 0)
        starts = (starts,) * len(columns) if isinstance(starts, int) else tuple(starts)
        out.append(Part(e["key"], columns, starts, widths, e.get("time_offset", 0), e.get("flip", False)))
    return out


def shared_queries(parts: Sequence[Part], steps: int) -> dict[str, list[int]]:
    """Offsets to read of each raw column, once for all parts that draw on it."""
    out: dict[str, set[int]] = {}
    for p in parts:
        for c in p.columns:
            out.setdefault(c, set()).update(range(p.time_offset, p.time_offset + steps))
    return {c: sorted(o) for c, o in out.items()}


def flatten(tree: dict, sep: str = "/") -> dict:
    """Nested keys joined by ``sep``."""
    out = {}
    for k, v in tree.items():
        if isinstance(v, dict):
            out |= {f"{k}{sep}{x}": y for x, y in flatten(v, sep).items()}
        else:
            out[k] = v
    return out


def unflatten(flat: dict, sep: str = "/") -> dict:
    """The inverse of :func:`flatten`."""
    out: dict = {}
    for k, v in flat.items():
        *path, last = k.split(sep)
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dictionaries merged at every level."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def processors(sources: dict[str, str], per_type: dict[str, dict], base: dict | None = None, overrides: dict | None = None, whole: Sequence[str] = ("action_state_merger",), own: Sequence[str] = ()) -> dict[str, dict]:
    """The configuration of each embodiment type: that of the type with ``base`` laid on it, then ``overrides``.

    ``sources`` has the type of each source.  ``per_type`` must have just the types that sources use.  Keys in ``whole`` are
    replaced by the base's, not merged; keys in ``own`` stay those of the type.  The type is added under ``embodiment_type``.
    """
    wanted = set(sources.values())
    if set(per_type) != wanted:
        raise ValueError(f"configurations must be those of the embodiment types; missing: {sorted(wanted - set(per_type))}; extra: {sorted(set(per_type) - wanted)}")
    out = {}
    for kind in sorted(wanted):
        merged = deep_merge(per_type[kind], base or {})
        merged |= {k: base[k] for k in whole if base and base.get(k) is not None}
        merged |= {k: per_type[kind][k] for k in own if k in per_type[kind]}
        out[kind] = merged | (overrides or {}) | {"embodiment_type": kind}
    return out


def equal_sources(configurations: Iterable[tuple[str, str, dict]]) -> dict[str, dict]:
    """One configuration for each type of (source, type, configuration); sources of a type that differ raise."""
    out: dict[str, dict] = {}
    for source, kind, config in configurations:
        if out.setdefault(kind, config) != config:
            raise ValueError(f"embodiment type {kind} has sources with different configurations; the latest is {source}")
    return out


def consistent(config: dict, there: Callable[[str], bool], folder: str = "model/tokenizer/vq_config/ckpt_dir", width: str = "model/model_arch/action_dim", parts: str = "model/tokenizer/vq_config/max_action_shape_meta") -> None:
    """Raises with all problems of a configuration at once: a folder that is not there, a width that is not the sum of its parts."""

    def at(path: str):
        node = config
        for k in path.split("/"):
            node = node.get(k) if isinstance(node, dict) else None
        return node

    errors = []
    if isinstance(at(folder), str) and not there(at(folder)):
        errors.append(f"{folder}: {at(folder)} does not exist")
    if isinstance(at(width), int) and isinstance(at(parts), dict) and at(width) != sum(at(parts).values()):
        errors.append(f"{width}: {at(width)} is not {sum(at(parts).values())}, the sum of {parts}")
    if errors:
        raise ValueError("; ".join(errors))


def map_leaves(tree: dict, function: Callable) -> dict:
    """``function`` of every leaf of nested dictionaries."""
    return {k: map_leaves(v, function) if isinstance(v, dict) else function(v) for k, v in tree.items()}


def passes_through(columns: Sequence[str], used: Sequence[str]) -> list[str]:
    """Columns that no part consumes and that are neither observation nor action."""
    return [c for c in columns if c not in used and "observation" not in c and "action" not in c]


def json_safe(x):
    """Numbers that JSON has no form for become null, at any depth."""
    if isinstance(x, dict):
        return {k: json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def version_check(found: str, wanted: str) -> str:
    """"ok", or "warn" for an older minor version; an older major one raises."""
    f, w = (tuple(int(x) for x in v.lstrip("v").split(".")[:2]) for v in (found, wanted))
    if f[0] < w[0]:
        raise ValueError(f"version {found} is too old for {wanted}")
    return "warn" if f < w else "ok"
