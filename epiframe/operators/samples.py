"""Samples: camera slots, augmentation, collation, template rows, adapters and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from epiframe.functions import text as T
from epiframe.operators.selection import hashed_uniform, is_missing

#: Words in a camera's name and the slot they stand for, in order of priority.
CAMERA_SLOTS = (("wrist_left", r"(left.*(wrist|hand))|((wrist|hand).*left)"), ("wrist_right", r"(right.*(wrist|hand))|((wrist|hand).*right)"), ("wrist", r"wrist|hand|gripper"), ("exterior", r"ext|front|top|head|side|base|cam|image"))


def camera_name(raw: Column) -> Column:
    """Lower-cased name with runs of other signs as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def camera_slot(raw: Column) -> Column:
    """The slot of a camera by its name; null if none fits."""
    name = camera_name(raw)
    c = F.lit(None).cast("string")
    for slot, pattern in reversed(CAMERA_SLOTS):
        c = F.when(name.rlike(pattern), slot).otherwise(c)
    return c


def pick_cameras(cameras: DataFrame, dataset: str, raw: str, priority: Sequence[str]) -> DataFrame:
    """One raw camera per dataset and slot: the first by a priority of words in its name, then by name."""
    rank = F.lit(len(priority))
    for i in range(len(priority) - 1, -1, -1):
        rank = F.when(F.col(raw).contains(priority[i]), i).otherwise(rank)
    c = cameras.withColumn("slot", camera_slot(F.col(raw))).where("slot is not null")
    order = Window.partitionBy(dataset, "slot").orderBy(rank, raw)
    return c.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def fill_slots(images: Column, slots: Sequence[str], dummy: Column) -> Column:
    """Images of all slots in order; absent ones are the dummy."""
    return F.array(*(F.coalesce(F.try_element_at(images, F.lit(s)), dummy) for s in slots))


def time_shift(chunk: Column, key: Column, most: int, seed: int = 0) -> Column:
    """The chunk moved by a repeatable number of steps in [-most, most], held at its ends."""
    by = (F.floor(hashed_uniform(key, seed=seed) * (2 * most + 1)) - most).cast("int")
    return F.transform(chunk, lambda _, i: F.element_at(chunk, F.greatest(F.lit(0), F.least(i + by, F.size(chunk) - 1)) + 1))


def amplitude(chunk: Column, key: Column, spread: float, seed: int = 0) -> Column:
    """The chunk scaled by a repeatable factor in [1 - spread, 1 + spread]."""
    k = 1 + (hashed_uniform(key, seed=seed) * 2 - 1) * spread
    return F.transform(chunk, lambda x: x * k)


def collate(samples: DataFrame, batch: str, vector: str, order: Sequence[str]) -> DataFrame:
    """(batch, rows, same_width): the vectors of each batch in order, and whether they stack.

    A batch is bounded by the batch size that numbered it.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(vector).alias("_v"))))
    return samples.groupBy(batch).agg(F.transform(rows, lambda r: r["_v"]).alias("rows"), (F.min(F.size(vector)) == F.max(F.size(vector))).alias("same_width"))


def leaves(schema: StructType, skip: Sequence[str] = (), prefix: str = "") -> list[str]:
    """Paths of the columns of a table, fields of structs at any depth."""
    out = []
    for f in schema:
        if (path := f"{prefix}{f.name}") in skip:
            continue
        out += leaves(f.dataType, skip, f"{path}.") if isinstance(f.dataType, StructType) else [path]
    return out


def collate_tree(samples: DataFrame, batch: str, order: Sequence[str], metadata: Sequence[str] = (), ragged: Sequence[str] = ()) -> DataFrame:
    """(batch, a column ``a.b`` for each leaf with the batch's values in order, metadata, unstackable).

    Structs are gone into at any depth.  ``unstackable`` names the leaves whose arrays differ in length (these, and those
    in ``ragged``, stay lists; a null counts as another length); ``metadata`` columns come as one list of structs.  A batch
    is bounded by the batch size that numbered it.
    """
    paths = leaves(samples.schema, [batch, *metadata])
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*(F.col(p).alias(f"v{i}") for i, p in enumerate(paths)), F.struct(*(F.col(m) for m in metadata), F.lit(0).alias("_")).alias("m")).alias("_v"))))
    lists = samples.groupBy(batch).agg(rows.alias("_rows"))
    of = lambda name: F.transform("_rows", lambda r: r["_v"][name])
    kinds = {p: samples.select(p).schema[0].dataType for p in paths}
    uneven = [F.when(F.size(F.array_distinct(F.transform(of(f"v{i}"), lambda x: F.coalesce(F.size(x), F.lit(-1))))) > 1, p) for i, p in enumerate(paths) if isinstance(kinds[p], ArrayType) and p not in ragged]
    named = F.filter(F.array(*uneven), lambda x: x.isNotNull()) if uneven else F.array().cast("array<string>")
    meta = [F.transform("_rows", lambda r: F.struct(*(r["_v"]["m"][m].alias(m) for m in metadata))).alias("metadata")] if metadata else []
    return lists.select(batch, *(of(f"v{i}").alias(p) for i, p in enumerate(paths)), *meta, named.alias("unstackable"))


def concat_batches(batches: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of several batches' arrays one behind the other, column by column; a batch without a column adds nothing to it."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*columns).alias("_v"))))
    joined = lambda c: F.flatten(F.filter(F.transform("_rows", lambda r: r["_v"][c]), lambda x: x.isNotNull()))
    return batches.groupBy(*by).agg(rows.alias("_rows")).select(*by, *(joined(c).alias(c) for c in columns))


def widths_seen(samples: DataFrame, batch: str, vector: str) -> DataFrame:
    """Which widths a batch mixes, for a report on why it does not stack."""
    return samples.groupBy(batch, F.size(vector).alias("width")).agg(F.count("*").alias("n"))


def padded_sequence(tokens: Column, labels: Column, width: int, pad: int, ignore: int) -> tuple[Column, Column, Column]:
    """(tokens, labels, mask) of exactly ``width``: cut on the right, or padded and ignored."""
    fill = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.greatest(F.lit(width) - F.size(c), F.lit(0)))), 1, width)
    return fill(tokens, pad), fill(labels, ignore), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < F.size(tokens))


#: Builders by name: (applicable, text) over the columns of an annotated frame.
BUILDERS = {
    "task": (lambda: ~is_missing(F.col("task")), lambda: F.concat(F.lit("Task: "), F.col("task"))),
    "plan": (lambda: ~is_missing(F.col("plan")), lambda: F.concat(F.lit("Plan: "), F.col("plan"))),
    "boxes": (lambda: T.boxes_text(F.col("boxes")).isNotNull(), lambda: T.boxes_text(F.col("boxes"))),
    "trace": (lambda: T.trace_text(F.col("trace")).isNotNull(), lambda: T.trace_text(F.col("trace"))),
    "memory": (lambda: ~is_missing(F.col("memory")), lambda: F.concat(F.lit("Memory: "), F.col("memory"))),
}


def build_samples(frames: DataFrame, weights: dict[str, float], key: str, seed: int = 0, fallback: str = "task") -> DataFrame:
    """Adds ``builder`` and ``sample``: a weighted choice among the builders that apply, repeatable by key."""
    names = list(weights)
    pick = T.weighted_choice([BUILDERS[n][0]() for n in names], [weights[n] for n in names], hashed_uniform(F.col(key), seed=seed))
    name = F.when(pick.isNull(), fallback).otherwise(F.element_at(F.array(*map(F.lit, names)), F.coalesce(pick, F.lit(0)) + 1))
    out = F.lit(None).cast("string")
    for n in {*names, fallback}:
        out = F.when(F.col("builder") == n, BUILDERS[n][1]()).otherwise(out)
    return frames.withColumn("builder", name).withColumn("sample", out)


def with_global_stats(episodes: DataFrame, stats: DataFrame) -> DataFrame:
    """One global row of statistics beside every episode."""
    return episodes.crossJoin(F.broadcast(stats.limit(1)))


def stamp_seconds(seconds: Column, nanoseconds: Column) -> Column:
    return seconds + nanoseconds / F.lit(1e9)


def trajectory_times(start: Column, step: float, count: Column) -> Column:
    """start + i * step for a trajectory's points."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: start + i * step)


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Result rows as JSON lines or as CSV with a header."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind {kind}")
