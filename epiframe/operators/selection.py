"""Splits, filters, validation, deterministic orders and sharding."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

MISSING_TEXT = ("", "null", "none", "nan", "-1")
#: Values of an annotation that mean "missing" besides null, NaN and -1.


def is_missing(c: Column) -> Column:
    """Whether an annotation, taken as text, counts as missing."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING_TEXT)


#: Rows that one bucket of a global order should hold, the most buckets, and the rows looked at for each bucket's bound.
BUCKET_ROWS = 250_000
MOST_BUCKETS = 8_192
BOUND_SAMPLE = 20


def order_bounds(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> list[Column]:
    """Upper bounds of all but the last bucket of a table's global order, as literal structs; none for one bucket.

    The driver sees at most BOUND_SAMPLE * MOST_BUCKETS rows of the order columns.
    """
    keys = df.select(*order)
    n = keys.count()
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS + 1) if buckets is None else buckets
    if buckets < 2 or not n:
        return []
    sample = keys.sample(min(1.0, 2 * BOUND_SAMPLE * buckets / n), 11).orderBy(F.struct(*order)).limit(BOUND_SAMPLE * MOST_BUCKETS).collect()
    picked = list(dict.fromkeys(sample[len(sample) * i // buckets] for i in range(1, buckets))) if sample else []
    types = [keys.schema[c].dataType for c in order]
    return [F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(row, types, order))) for row in picked]


def order_bucket(bounds: Sequence[Column], order: Sequence[str]) -> Column:
    """The number of a row's bucket: how many bounds are not above it, by binary search in as many steps as their number needs."""
    if not bounds:
        return F.lit(0)
    key, upper = F.struct(*order), F.array(*bounds)
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(upper, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def rank_rows(df: DataFrame, order: Sequence[str], out: str = "_rank", buckets: int | None = None) -> DataFrame:
    """0-based global rank of a table in the order of unique columns (nulls first), without a one-task window.

    Rows get a bucket of the order by literal bounds, buckets are counted, and rows are numbered from their bucket's
    start.  The bounds are fixed before the plan runs, so counts and rows agree however either is planned or run again.
    Two passes over the order columns come before the one shuffle of the rows.
    """
    bounds = order_bounds(df, order, buckets)
    bucketed = df.withColumn("_b", order_bucket(bounds, order))
    counts = df.select(order_bucket(bounds, order).alias("_b")).groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return bucketed.join(F.broadcast(starts), "_b").withColumn(out, (F.col("_s") + local).cast("long")).drop("_b", "_s")  # at most MOST_BUCKETS rows


def split_episodes(episodes: DataFrame, key: str, share: float, train: bool) -> DataFrame:
    """Episodes of one side of a split: the first ``int(n * (1 - share))`` train, at least one on each side; all on both below 1e-6."""
    if share < 1e-6:
        return episodes.select(key)
    n = episodes.count()
    cut = min(max(1, int(n * (1 - share))), max(1, n - 1))
    ranked = rank_rows(episodes.select(key), [key])
    return ranked.where(F.col("_rank") < cut if train else F.col("_rank") >= min(cut, n - 1)).select(key)


def successful_only(rows: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows of successful episodes; all rows if no episode is."""
    good = flags.where(F.col(flag) == 1).select(key).distinct()
    return rows.join(good, key, "left_semi") if good.limit(1).count() else rows


def _from_movement(frames: DataFrame, key: str, order: Sequence[str], shown: Callable[[Column | None], Column], threshold: float) -> DataFrame:
    """Frames of each episode from the first whose ``shown(frame before)`` is above the threshold on, or the last one if none is."""
    from epiframe.operators.episodes import Episodes

    e = Episodes.spread(frames.withColumn("_x", shown(None)), [key], order, back=1)
    moved = e.select(*frames.columns, shown(F.lag("_x").over(e.by)).alias("_move"))
    at = F.struct(*order)
    starts = moved.groupBy(F.col(key).alias("_key")).agg(F.coalesce(F.min(F.when(F.col("_move") > threshold, at)), F.max(at)).alias("_start"))
    return moved.join(starts, moved[key].eqNullSafe(starts["_key"])).where(at >= F.col("_start")).select(*frames.columns)


def first_movement(frames: DataFrame, key: str, order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Drops an episode's frames before the first whose change from the frame before is above the threshold; one that never moves keeps its last frame."""
    return _from_movement(frames, key, order, lambda before: F.col(value) if before is None else F.abs(F.col(value) - before), threshold)


def first_movement_of(frames: DataFrame, key: str, order: Sequence[str], vectors: Sequence[str], threshold: float) -> DataFrame:
    """As :func:`first_movement`, by the Euclidean norm of the change over all components of several vector parts."""
    whole = F.concat(*(F.col(v).cast("array<double>") for v in vectors))

    def shown(before: Column | None) -> Column:
        if before is None:
            return whole
        return F.sqrt(F.aggregate(F.zip_with(whole, before, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))

    return _from_movement(frames, key, order, shown, threshold)


def qualified_only(rows: DataFrame, flag: str) -> DataFrame:
    """Rows that are marked as qualified; a missing mark counts as one."""
    return rows.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(True)))


def inside_range(episodes: DataFrame, first: str, last: str, start: int, end: int) -> DataFrame:
    """Episodes whose frames all lie in [start, end]."""
    return episodes.where((F.col(first) >= start) & (F.col(last) <= end))


def unique_sorted(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of some columns, in their order across partitions."""
    return df.select(*columns).distinct().orderBy(*columns)


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both tables have, once."""
    return a.select(*keys).intersect(b.select(*keys))


def active_dims(chunk: Column, thresholds: Sequence[float], relative: bool, always: Sequence[int] = ()) -> Column:
    """For each dimension of a chunk of vectors whether it leaves its first value (or zero) by at least its threshold in the chunk's first half; those in ``always`` are."""
    half = F.slice(chunk, 1, F.floor(F.size(chunk) / 2).cast("int"))

    def moves(d: int, threshold: float) -> Column:
        base = F.get(F.get(chunk, F.lit(0)), F.lit(d)) if relative else F.lit(0.0)
        return F.exists(half, lambda row: F.abs(F.get(row, F.lit(d)) - base) >= threshold)

    return F.array(*(F.lit(True) if d in always else moves(d, t) for d, t in enumerate(thresholds)))


def zero_inactive_dims(chunk: Column, mask: Column) -> Column:
    """A chunk of vectors with the dimensions whose mask is false set to 0."""
    return F.transform(chunk, lambda row: F.zip_with(row, mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0))))


def constant_part(chunk: Column, start: int, width: int, threshold: float) -> Column:
    """Whether a part of a chunk of vectors stays the same at every step once it is binarised."""
    bits = F.transform(chunk, lambda row: F.transform(F.slice(row, start + 1, width), lambda x: x > threshold))
    return F.forall(bits, lambda b: b == F.get(bits, F.lit(0)))


def active(chunk: Column, threshold: float, relative: bool) -> Column:
    """Whether a scalar chunk leaves its first value (or zero) by at least ``threshold`` in its first half."""
    base = F.element_at(chunk, 1) if relative else F.lit(0.0)
    return F.exists(F.slice(chunk, 1, F.floor(F.size(chunk) / 2).cast("int")), lambda x: F.abs(x - base) >= threshold)


def threshold_for(key: Column, per_key: dict[str, float], gripper: float, pose: float, velocity: float, joint: float) -> Column:
    """The activity threshold of a part by its name: its own, else by kind."""
    c = F.lit(joint)
    c = F.when(key.rlike("torso|chassis"), velocity).otherwise(c)
    c = F.when(key.rlike("eef|ee_pose"), pose).otherwise(c)
    c = F.when(key.contains("gripper"), gripper).otherwise(c)
    for name, value in per_key.items():
        c = F.when(key == name, value).otherwise(c)
    return F.coalesce(c, F.lit(0.0))


def zero_where_inactive(chunk: Column, mask: Column) -> Column:
    return F.when(mask, chunk).otherwise(F.transform(chunk, lambda x: F.lit(0.0)))


def all_active(width: int) -> Column:
    return F.array_repeat(F.lit(True), width)


def noop_parts(mask: Column, padded: Column, start: int, width: int, constant: Column | None = None) -> Column:
    """Whether a part is inactive or padded in every dimension, or (a rule-based part) ``constant``."""
    m, p = F.slice(mask, start + 1, width), F.slice(padded, start + 1, width)
    idle = ~F.exists(m, lambda x: x) | F.forall(p, lambda x: x)
    return idle if constant is None else idle | constant


def clock_gaps(frames: DataFrame, key: str, order: Sequence[str], seconds: str, fps: float, tolerance: float) -> DataFrame:
    """Frames whose time since the one before differs from 1/fps by more than the tolerance; episode starts never do."""
    gap = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(key).orderBy(*order))
    return frames.withColumn("gap", gap).where(F.abs(F.col("gap") - 1.0 / fps) > tolerance)


def offsets_are_frames(offset: Column, fps: float, tolerance: float) -> Column:
    """Whether an offset in seconds is a whole number of frames, up to the tolerance."""
    return F.abs(offset * fps - F.bround(offset * fps)) / fps <= tolerance


def frame_errors(features: dict[str, tuple[str, int]]) -> Column:
    """Error texts of a frame against {column: (kind, width)}; kind is scalar, vector or string."""
    checks = []
    for name, (kind, width) in features.items():
        c = F.col(name)
        checks.append(F.when(c.isNull(), f"{name}: missing"))
        if kind == "vector":
            checks.append(F.when(F.size(c) != width, F.concat(F.lit(f"{name}: width "), F.size(c).cast("string"), F.lit(f", not {width}"))))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def observation_errors(df: DataFrame, required: dict[str, tuple[int, int | None, str]], texts: Sequence[str] = ()) -> tuple[Column, list[str]]:
    """(error texts of an observation, warnings) against {column: (rank, width of the innermost arrays or None, type of a value)} and text columns.

    A missing column and a rank that does not agree are errors of every row, as the schema tells; nulls and widths are looked
    at row by row.  A value type that differs is only a warning.
    """
    checks, warnings = [], []
    kinds = dict(df.dtypes)
    for name, (rank, width, kind) in required.items():
        if name not in kinds:
            checks.append(F.lit(f"{name}: missing"))
            continue
        t, depth = df.schema[name].dataType, 0
        while isinstance(t, ArrayType):
            t, depth = t.elementType, depth + 1
        if depth != rank:
            checks.append(F.lit(f"{name}: rank {depth}, not {rank}"))
            continue
        if t.simpleString() != kind:
            warnings.append(f"{name}: {t.simpleString()}, expected {kind}")
        checks.append(F.when(F.col(name).isNull(), F.lit(f"{name}: null")))
        if width is not None and depth:
            rows = F.col(name)
            for _ in range(depth - 2):
                rows = F.flatten(rows)
            off = F.size(rows) != width if depth == 1 else F.exists(rows, lambda r: F.size(r) != width)
            checks.append(F.when(off, F.lit(f"{name}: width is not {width}")))
    for name in texts:
        bad = name not in kinds or kinds[name] != "string"
        checks.append(F.lit(f"{name}: not a text") if bad else F.when(F.col(name).isNull(), F.lit(f"{name}: null")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull()), warnings


def quarantine(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their errors)."""
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def invalid_log(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per distinct problem: how often, and its first place."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))


def first_n(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in a total order, of the whole table or of each group; tasks keep n rows before any shuffle."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def coprime_stride(length: int) -> int:
    """A step near the golden section of ``length`` that shares no factor with it."""
    stride = max(1, int(length * 0.618))
    while math.gcd(stride, length) != 1:
        stride += 1
    return stride


def epoch_index(i: Column, length: int, epoch: int, dataset: int) -> Column:
    """Undersampling order of an epoch: a permutation of 0..length-1 by an affine step."""
    offset = (epoch * 1_000_003 + dataset) % length
    return (i * coprime_stride(length) + offset) % length


def oversample_index(i: Column, length: int) -> Column:
    return i % length


def resume_after(df: DataFrame, rank: str, start_batch: int, batch: int) -> DataFrame:
    return df.where(F.col(rank) >= start_batch * batch)


def rank_batches(df: DataFrame, group: str, order: Sequence[str], ranks: int, batch: int, rest: str = "keep", buckets: int | None = None) -> DataFrame:
    """Strided rank and batch number within each group; batches never mix groups.

    ``rest`` says what becomes of a group's last round of ``ranks * batch`` rows if it is not full: "keep" leaves it short,
    "drop" drops it, "pad" fills it with the group's rows again, from its first.
    """
    from epiframe.operators.spread import numbered

    out = numbered(df, [group], order, "_i", "_n", buckets)
    size = ranks * batch
    if rest == "drop":
        out = out.where(F.col("_i") < F.floor(F.col("_n") / size) * size)
    elif rest == "pad":
        whole = F.ceil(F.col("_n") / size) * size
        # A row stands at its place and at each whole number of group lengths behind it, up to the full round.
        out = out.withColumn("_i", F.explode(F.expr("sequence(_i, _i + _n * floor((ceil(_n / {0}) * {0} - 1 - _i) / _n), _n)".format(size)))).where(F.col("_i") < whole)
    elif rest != "keep":
        raise ValueError(f"unknown rest {rest}")
    return out.withColumns({"rank": (F.col("_i") % ranks).cast("long"), "batch": F.floor(F.floor(F.col("_i") / ranks) / batch).cast("long")}).drop("_i", "_n")


def strided_shard(rank: Column, shards: int, k: int) -> Column:
    return F.pmod(rank, F.lit(shards)) == k


def hashed_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A repeatable uniform number in [0, 1) of the keys and a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def missing_keys(wanted: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).exceptAll(known.select(*keys)).distinct()


def key_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two flattened tables; an absent side is ``<MISSING>``, a null value stays null."""
    side = lambda df, name: df.select(F.col(key).alias("key"), F.struct(F.col(value).cast("string").alias("v")).alias(name))
    j = side(a, "l").join(side(b, "r"), "key", "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    shown = lambda name: F.when(F.col(name).isNull(), F.lit("<MISSING>")).otherwise(F.col(name)["v"])
    return j.select("key", shown("l").alias("left_value"), shown("r").alias("right_value"))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return first_n(df, 1, order, key)
