"""Per-step, per-episode, global and mixture statistics.

Long form throughout: one row per (group, step, dim) value.  Means, deviations
and extremes are partial aggregates that combine before the shuffle.  Exact
order statistics take two passes: sketches bound each wanted place from both
sides, then only values between the bounds are kept apart (those elsewhere are
counted together before the shuffle), so a group's sorted window is a small
share of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Low and high quantiles that statistics carry.
LOW = (0.01, 0.001, 0.0001, 0.00001)
HIGH = (0.99, 0.999, 0.9999, 0.99999)


def quantile_name(q: float) -> str:
    """0.01 -> q01, 0.999 -> q999, 0.00001 -> q00001."""
    return "q" + f"{q:.5f}".split(".")[1].rstrip("0")


def _moments(value: str, population: bool = False) -> list[Column]:
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    return [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), std.alias("std")]


def moments(rows: DataFrame, by: Sequence[str], value: str = "value", population: bool = False) -> DataFrame:
    """n, min, max, mean, std of each group."""
    return rows.groupBy(*by).agg(*_moments(value, population))


#: Accuracy of the sketches (their rank error is n / ACCURACY) and the distance of the bounds from a wanted place, in errors.
ACCURACY = 10_000
MARGIN = 4
#: Groups whose bounds are sent to every task as literals (about 200 bytes each); more groups are joined.
LITERAL_GROUPS = 10_000


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_by_{c}"]) for c in by), F.lit(True))


def _sketched(rows: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str, *more: Column) -> tuple[DataFrame, bool, list[float]]:
    """(a sketch of each group with its size and ``more`` aggregates, whether these are few and collected, the places of its bounds)."""
    wanted = sorted({min(1.0, max(0.0, q + side * MARGIN / ACCURACY)) for q in quantiles for side in (-1, 1)})
    sketch = rows.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.percentile_approx(value, [float(q) for q in wanted], ACCURACY).alias("_s"), F.count(value).alias("_m"), *more)
    few = sketch.limit(LITERAL_GROUPS + 1).collect()
    if len(few) <= LITERAL_GROUPS:
        return rows.sparkSession.createDataFrame(few, sketch.schema), True, wanted
    return sketch, False, wanted


def _placed(rows: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str, sketched: tuple[DataFrame, bool, list[float]]) -> DataFrame:
    """(by, _v, _c, _end, _n, _kept): values of each group near the wanted places with how many there are and up to them.

    Values outside the bounds are in rows with ``_kept`` false, counted by the bound below them; groups of at most
    ACCURACY values, where the margin is less than some places, keep all.
    """
    sketch, few, wanted = sketched
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sketch = sketch.select(*(f"_by_{c}" for c in by), "_s", "_m")
    joined = known.join(F.broadcast(sketch) if few else sketch, _same(known, sketch, by))
    place = {q: i for i, q in enumerate(wanted)}
    s = lambda q: F.get("_s", F.lit(place[q]))
    v = F.col("_v")
    spans = [(max(0.0, q - MARGIN / ACCURACY), min(1.0, q + MARGIN / ACCURACY)) for q in quantiles]
    kept = reduce(lambda a, b: a | b, ((v >= s(lo)) & (v <= s(hi)) for lo, hi in spans), F.col("_m") <= ACCURACY)
    below = F.array_max(F.filter("_s", lambda x: x < v))
    counted = joined.select(*by, kept.alias("_kept"), F.when(kept, v).otherwise(below).alias("_v")).groupBy(*by, "_kept", "_v").agg(F.count("*").alias("_c"))
    # Values between two bounds are all kept or all counted together, so the latter follow the bound below them.
    w = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first(), F.col("_kept").desc())
    return counted.withColumns({"_end": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(Window.partitionBy(*by))})


def _hit(place: Column) -> Column:
    return (F.col("_end") > place) & (F.col("_end") - F.col("_c") <= place)


def _found(rows: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str, places: dict[str, Column], sketched) -> DataFrame:
    """(by, _n, a column for each place): the values at 0-based places of each group's sorted values.

    A place that lies outside its bounds (which the sketch's error makes all but impossible) sends its group through one
    more pass that sorts the whole group; without such groups that pass has nothing to read.
    """
    sketched = sketched or _sketched(rows, by, quantiles, value)
    at = [F.max(F.when(_hit(p) & F.col("_kept"), F.col("_v"))).alias(name) for name, p in places.items()]
    missed = reduce(lambda a, b: a | b, (_hit(p) & ~F.col("_kept") for p in places.values()))
    first = _placed(rows, by, quantiles, value, sketched).groupBy(*by).agg(F.max("_n").alias("_n"), *at, F.coalesce(F.max(missed), F.lit(False)).alias("_missed"))
    again = first.where("_missed").select(*(F.col(c).alias(f"_by_{c}") for c in by))
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    whole = known.join(F.broadcast(again) if sketched[1] else again, _same(known, again, by), "left_semi")
    w = Window.partitionBy(*by)
    sorted_ = whole.withColumns({"_kept": F.lit(True), "_c": F.lit(1), "_end": F.row_number().over(w.orderBy("_v")), "_n": F.count("*").over(w)})
    second = sorted_.groupBy(*by).agg(F.max("_n").alias("_n"), *at)
    # An aggregate without groups has a row even of nothing.
    second = second if by else second.where("_n is not null")
    return first.where("not _missed").drop("_missed").unionByName(second)


def floor_quantiles(rows: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str = "value", sketched=None) -> DataFrame:
    """The value at place ``int(q * (n - 1))`` of each group's sorted values, one column per quantile."""
    places = {quantile_name(q): F.floor(F.lit(q) * (F.col("_n") - 1)) for q in quantiles}
    return _found(rows, by, quantiles, value, places, sketched).drop("_n")


def linear_quantiles(rows: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str = "value") -> DataFrame:
    """Linearly interpolated exact quantiles, from the values at the two places around ``q * (n - 1)``."""
    place = lambda q: F.lit(q) * (F.col("_n") - 1)
    places = {f"{side}{i}": f(place(q)) for i, q in enumerate(quantiles) for side, f in (("_lo", F.floor), ("_hi", F.ceil))}
    found = _found(rows, by, quantiles, value, places, None)

    def between(i: int, q: float) -> Column:
        lo, hi, at = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double"), place(q)
        return F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return found.select(*by, *(between(i, q).alias(quantile_name(q)) for i, q in enumerate(quantiles)))


def approximate_quantiles(rows: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str = "value", accuracy: int = ACCURACY) -> DataFrame:
    """Quantiles from one mergeable sketch a group, with a rank error of at most n / accuracy."""
    found = rows.groupBy(*by).agg(F.percentile_approx(value, [float(q) for q in quantiles], accuracy).alias("_s"))
    return found.select(*by, *(F.get("_s", F.lit(i)).alias(quantile_name(q)) for i, q in enumerate(quantiles)))


def step_statistics(rows: DataFrame, by: Sequence[str], value: str = "value", quantiles: Sequence[float] = (*LOW, *HIGH)) -> DataFrame:
    """Moments and floor quantiles of each group that has a value; moments come with the sketches, in one pass."""
    sketch, few, wanted = sketched = _sketched(rows, by, quantiles, value, *_moments(value))
    found = floor_quantiles(rows, by, quantiles, value, sketched)
    side = sketch.drop("_s", "_m")
    both = found.join(F.broadcast(side) if few else side, _same(found, side, by))
    return both.select(*by, "n", "min", "max", "mean", "std", *(quantile_name(q) for q in quantiles))


def transformed_steps(frames: DataFrame, chunk: Column, transform: Callable[[Column], Column], by: Sequence[str] = (), quantiles: Sequence[float] = (*LOW, *HIGH)) -> DataFrame:
    """Statistics by step and dimension of chunks of vectors after a transform.

    The transform is applied to whole chunks once; it must be causal (step j may only depend on steps up to j), as the
    statistics of step j then equal those of chunks cut after it.
    """
    rows = frames.select(*by, F.posexplode(transform(chunk)).alias("step", "_row")).select(*by, "step", F.posexplode("_row").alias("dim", "value"))
    return step_statistics(rows, [*by, "step", "dim"], quantiles=quantiles)


def transformed_states(frames: DataFrame, state: Column, transform: Callable[[Column], Column], by: Sequence[str] = (), quantiles: Sequence[float] = (*LOW, *HIGH)) -> DataFrame:
    """Statistics by dimension of state vectors after a transform."""
    rows = frames.select(*by, F.posexplode(transform(state)).alias("dim", "value"))
    return step_statistics(rows, [*by, "dim"], quantiles=quantiles)


def first_frame_means(frames: DataFrame, key: Sequence[str], order: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """Mean value of episodes' first frames."""
    first = frames.groupBy(*key).agg(F.min_by(F.struct(*by, value), F.struct(*order)).alias("_f")).select("_f.*")
    return first.groupBy(*by).agg(F.avg(value).alias("init"))


def capped_lengths(lengths: DataFrame, length: str, nodes: DataFrame, available: str) -> DataFrame:
    """Lengths scaled so that their sum is the least that any node has: ``max(1, int(l * s))``, and never more than they are."""
    least = nodes.agg(F.min(available).alias("_a")).crossJoin(lengths.agg(F.sum(length).alias("_t")))
    scale = F.least(F.lit(1.0), F.col("_a") / F.col("_t"))
    return lengths.crossJoin(F.broadcast(least)).withColumn("capped", F.greatest(F.lit(1), F.floor(F.col(length) * scale)).cast("long")).drop("_a", "_t")  # one row


def global_from_steps(steps: DataFrame, by: Sequence[str], low: Sequence[str] = (), high: Sequence[str] = ()) -> DataFrame:
    """One row from the statistics of several steps: extremes, mean of means, and the spread within and between steps."""
    spread = F.when(F.count("*") > 1, F.sqrt(F.avg(F.col("std") * F.col("std")) + F.var_samp("mean"))).otherwise(F.max("std"))
    return steps.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), spread.alias("std"), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high))


def unweighted_over_episodes(episodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics over episodes that count alike: std from the variances and the means' squared distances."""
    mean = F.avg("mean").over(Window.partitionBy(*by))
    e = episodes.withColumn("_m", mean)
    return e.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") * F.col("std") + (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m")))).alias("std"))


def count_weighted(parts: DataFrame, by: Sequence[str], weight: str = "n") -> DataFrame:
    """Parallel variance: statistics of a whole from those of its parts, weighted (population std in, population std out)."""
    w, m, s = F.col(weight), F.col("mean"), F.col("std")
    total = F.sum(w)
    second = F.sum(w * (s * s + m * m)) / total
    mean = F.sum(w * m) / total
    return parts.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"), total.alias(weight))


def mixture(parts: DataFrame, by: Sequence[str], weight: str, quantiles: Sequence[str] = ()) -> DataFrame:
    """Weighted mixture: pooled mean and std, extreme min and max, averaged quantiles; weights need not sum to 1."""
    w = F.col(weight)
    pooled = count_weighted(parts, by, weight).drop(weight)
    if not quantiles:
        return pooled
    return pooled.join(parts.groupBy(*by).agg(*((F.sum(w * F.col(q)) / F.sum(w)).alias(q) for q in quantiles)), list(by))


def normalised_weights(groups: DataFrame, length: str, weight: str) -> DataFrame:
    """``w * sum(L) / sum(L * w)``, so that effective lengths keep their sum; a bad sum raises."""
    s = groups.agg(F.sum(length).alias("_l"), F.sum(F.col(length) * F.col(weight)).alias("_lw"))
    k = F.when(F.col("_lw") > 0, F.col("_l") / F.col("_lw")).otherwise(F.raise_error(F.lit("weights must have a positive sum")).cast("double"))
    return groups.crossJoin(F.broadcast(s)).withColumn("norm_weight", k * F.col(weight)).drop("_l", "_lw")


def effective_length(length, weight):
    """``max(1, int(L * w))``; a weight that is not positive raises."""
    return F.when(weight > 0, F.greatest(F.lit(1), F.floor(length * weight))).otherwise(F.raise_error(F.lit("a weight must be positive")).cast("long")).cast("long")


def sample_size(n, least: int = 100, most: int = 10_000, power: float = 0.75):
    """How many of n rows a heuristic sample takes."""
    return F.greatest(F.lit(least), F.least(F.floor(F.pow(n, F.lit(power))), F.lit(most))).cast("long")


def even_places(n: int, k: int) -> list[int]:
    """k evenly spaced places among n, halves to even."""
    return [round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)]


def anchors(n, stride: int):
    """0, stride, 2 * stride, ... below n."""
    return F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stride).cast("long"))
