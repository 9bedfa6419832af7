"""Joins: dictionaries, ranges, nearest in time, overrides.

Range and nearest joins are equi-joins on a bucket of the ordered column, so
they hash and spill like any join; a bucket as wide as the tolerance means each
row looks into three buckets at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiframe.operators.spread import neighbours


def decode(rows: DataFrame, key: str, dictionary: DataFrame, dict_key: str, text: str, out: str, missing: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Text of a dictionary index; of repeated entries the first in ``order`` counts (ties, and no order: the smallest text); ``missing`` where there is none."""
    once = dictionary.groupBy(F.col(dict_key).alias("_k")).agg(F.min(F.struct(*order, F.struct(text).alias("_t")))["_t"][text].alias("_t"))
    found = rows.join(once, F.col(key) == F.col("_k"), "left")
    return found.withColumn(out, F.col("_t") if missing is None else F.coalesce(F.col("_t"), F.lit(missing))).drop("_k", "_t")


def decode_ordinal(rows: DataFrame, key: str, dictionary: DataFrame, order: Sequence[str], text: str, out: str, buckets: int | None = None) -> DataFrame:
    """Text at a place of an ordered dictionary."""
    from epiframe.operators.selection import rank_rows

    placed = rank_rows(dictionary.select(*order, text), order, "_k", buckets).select("_k", F.col(text).alias("_t"))
    return rows.join(placed, F.col(key) == F.col("_k"), "left").withColumn(out, F.col("_t")).drop("_k", "_t")


def in_range(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Each point with the ranges [start, end) that hold it.

    Ranges are listed in the buckets they touch.  Buckets are ``width`` wide, or 16, 256, ... times as wide for longer
    ranges, so that a range of any length touches three at most; a point looks into one bucket of each width in use (at
    most 16, collected when this is called).
    """
    size = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.least(F.lit(15), F.ceil(F.log(size / width) / math.log(16)))).cast("int")
    of = ranges.where(size > 0).withColumn("_l", level)
    used = sorted(r[0] for r in of.select("_l").distinct().collect())
    bucket = lambda x: F.floor(x / (F.lit(float(width)) * F.pow(F.lit(16.0), F.col("_l"))))
    spread = of.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))))
    p = points.withColumn("_l", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))).withColumn("_b", bucket(F.col(point)))
    return p.join(spread, ["_l", "_b"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_l", "_b")


def nearest_within(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, tolerance: int, left_id: str, value: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """For each left row the right row of its key nearest in time within the tolerance; null where none is; ties by ``tie``."""
    l = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col(time) / tolerance) + o for o in (-1, 0, 1)))))
    r = right.select(F.col(key), F.col(right_time).alias("_t"), *value, *[c for c in tie if c not in value], F.floor(F.col(right_time) / tolerance).alias("_b"))
    gap = F.abs(F.col(time) - F.col("_t"))
    best = l.join(r, [key, "_b"]).where(gap <= tolerance).groupBy(left_id).agg(F.min_by(F.struct(*value), F.struct(gap, *tie)).alias("_m"))
    return left.join(best, left_id, "left").select(*left.columns, *(F.col("_m")[c].alias(c) for c in value))


def nearest_latest(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """For each left row the right row of its key nearest in time, however far; of two as near the later one.

    Both sides are merged in time order, cut into buckets where a key is long:
    the nearest is the last right row at or before, or the first after; no pairs are made.
    """
    both = left.withColumn("_r", F.lit(False)).unionByName(right.select(*key, time, value).withColumn("_r", F.lit(True)).withColumnRenamed(value, "_w"), allowMissingColumns=True)
    hit = F.when(F.col("_r"), F.struct(F.col(time).alias("t"), F.col("_w").alias("v")))
    m = neighbours(both, key, time, hit, [F.col("_w")], "_a", "_z", buckets).where(~F.col("_r"))
    later = F.col("_a").isNull() | (F.col("_z")["t"] - F.col(time) <= F.col(time) - F.col("_a")["t"])
    return m.withColumn(out, F.when(F.col("_z").isNotNull() & later, F.col("_z")["v"]).otherwise(F.col("_a")["v"])).select(*left.columns, out)


def override(rows: DataFrame, keys: Sequence[str], special: DataFrame, text: str, fallback: Column, out: str) -> DataFrame:
    """The text of a special table by keys, else a fallback."""
    s = special.select(*keys, F.col(text).alias("_o"))
    return rows.join(s, list(keys), "left").withColumn(out, F.coalesce(F.col("_o"), fallback)).drop("_o")


def require(df: DataFrame, c: str, message: str) -> DataFrame:
    """Raises at run time where a looked-up value is null."""
    return df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(message)).cast(df.schema[c].dataType)).otherwise(F.col(c)))


def requested_rows(asked: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each request with the row it names: many requests of one row read it once, a request without a row is dropped."""
    return asked.join(rows, list(on))


def remapped_vocabulary(old: DataFrame, new: DataFrame, name: str, token: str) -> DataFrame:
    """(name, old_id, new_id) over two dictionaries: null where one has no such name."""
    return old.select(name, F.col(token).alias("old_id")).join(new.select(name, F.col(token).alias("new_id")), name, "full_outer")
