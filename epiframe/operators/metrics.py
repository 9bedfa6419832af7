"""Metrics of predictions against truth; every ratio is a sum over a sum, so parts combine in any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = 1 / 256


def long_errors(df: DataFrame, truth: str, guess: str, mask: str | None, keep: Sequence[str]) -> DataFrame:
    """One row per component: dim, truth, guess, whether it counts."""
    cols = [F.col(truth).alias("t"), F.col(guess).alias("g")] + ([F.col(mask).alias("m")] if mask else [])
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*cols)).alias("dim", "z"))
    return rows.select(*keep, "dim", F.col("z.t").alias("truth"), F.col("z.g").alias("guess"), (F.col("z.m") if mask else F.lit(True)).alias("counts"))


def threshold_accuracy(rows: DataFrame, by: Sequence[str] = (), close: float = CLOSE) -> DataFrame:
    """Share of counted components closer than ``close``, and their mean absolute error; 0 where none counts."""
    gap = F.abs(F.col("truth") - F.col("guess"))
    n = F.greatest(F.sum(F.when(F.col("counts"), 1).otherwise(0)), F.lit(1))
    return rows.groupBy(*by).agg((F.sum(F.when(F.col("counts") & (gap < close), 1).otherwise(0)) / n).alias("accuracy"), (F.sum(F.when(F.col("counts"), gap).otherwise(0.0)) / n).alias("l1"))


def part_of(dim: Column, parts: Sequence[tuple[str, int, int]]) -> Column:
    """The part (name, start, end) that a dimension lies in, else null."""
    c = F.lit(None).cast("string")
    for name, start, end in parts:
        c = F.when((dim >= start) & (dim < end), name).otherwise(c)
    return c


def part_l1(rows: DataFrame, parts: Sequence[tuple[str, int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error of each part that has a counted component."""
    r = rows.where("counts").withColumn("part", part_of(F.col("dim"), parts)).where("part is not null")
    return r.groupBy(*by, "part").agg(F.avg(F.abs(F.col("truth") - F.col("guess"))).alias("l1"))


def binary_accuracy(rows: DataFrame, parts: Sequence[tuple[str, int, int]], threshold: float) -> DataFrame:
    """Share of components of each part on the same side of the threshold."""
    r = rows.where("counts").withColumn("part", part_of(F.col("dim"), parts)).where("part is not null")
    return r.groupBy("part").agg(F.avg(((F.col("truth") > threshold) == (F.col("guess") > threshold)).cast("double")).alias("accuracy"))


def merge_payload(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sums of counts and means of everything else, over the ranks that report a key."""
    counted = F.col(key).endswith("sample_count") | F.col(key).endswith("meta/num_samples")
    return rows.groupBy(key).agg(F.when(F.first(counted), F.sum(value)).otherwise(F.avg(value)).alias(value))


def token_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Share of tokens guessed right over all rows; guesses are cut or filled with zeros to the truth's length."""
    t, g = F.col(truth), F.col(guess)
    fit = F.slice(F.concat(g, F.array_repeat(F.lit(0).cast("long"), F.size(t))), 1, F.size(t))
    hits = F.aggregate(F.zip_with(t, fit, lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.agg((F.sum(hits) / F.sum(F.size(t))).alias("accuracy"))


def macro_l1(rows: DataFrame, sample: Sequence[str]) -> DataFrame:
    """Mean over samples of their masked mean absolute error; -1 if none has any."""
    each = rows.where("counts").groupBy(*sample).agg(F.avg(F.abs(F.col("truth") - F.col("guess"))).alias("l1"))
    return each.agg(F.coalesce(F.avg("l1"), F.lit(-1.0)).alias("l1"))


def success_rates(rows: DataFrame, task: str, success: str) -> DataFrame:
    """Successes, trials and rate of each task and, as ``__overall__``, of all together."""
    r = rows.rollup(task).agg(F.sum(F.col(success).cast("long")).alias("successes"), F.count("*").alias("trials"), F.grouping(task).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "__overall__").otherwise(F.col(task)).alias(task), "successes", "trials", (F.col("successes") / F.col("trials")).alias("rate"))


def phase_rates(rows: DataFrame, task: str, phases: Sequence[str]) -> DataFrame:
    """Mean of each phase's mark by task, nulls left out, and under ``__overall__`` the mean of the tasks' rates."""
    each = rows.groupBy(task).agg(*(F.avg(F.col(p).cast("double")).alias(p) for p in phases))
    return each.unionByName(each.agg(*(F.avg(p).alias(p) for p in phases)).withColumn(task, F.lit("__overall__")))


def accumulated_means(rows: DataFrame, step: str, field: str, value: str, allowed: Sequence[str]) -> DataFrame:
    """Mean over a step's micro-batches of each allowed field; fields that none reports are not there."""
    return rows.where(F.col(field).isin(*allowed) & F.col(value).isNotNull()).groupBy(step, field).agg(F.avg(value).alias(value))
