"""Open-loop evaluation: chunks predicted at each frame against what the episode did.

A frame's truth is the chunk that begins at it (a window over blocks of
frames), so prediction and truth stand in one row: nothing is exploded to be
joined.  Errors are summed inside the row by step, and by step only they leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiframe.functions import align, kernels, normalize
from epiframe.operators.episodes import BLOCK_ROWS, Episodes
from epiframe.operators.metrics import CLOSE, merge_payload


def with_truth(frames: DataFrame, key: Sequence[str], order: Sequence[str], action: str, horizon: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``truth``, the next ``horizon`` actions, and ``past``, which of them lie past the episode's end."""
    e = Episodes.spread(frames, key, order, ahead=max(horizon - 1, 0), rows=rows)
    return e.select(*frames.columns, e.chunk(action, horizon).alias("truth"), e.chunk_pad(horizon).alias("past"))


def last_step(observations: Column) -> Column:
    """The last of a frame's observation steps, as a server takes them."""
    return F.try_element_at(observations, F.lit(-1))


def _nothing() -> Column:
    """Sums in which nothing counts."""
    return F.struct(F.lit(0.0).alias("l1"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("n"))


def _row_sums(guess: Column, truth: Column, valid: Column | None, close: float) -> Column:
    """(l1, hits, n) of one step: sums over the dimensions that are valid."""
    gaps = F.zip_with(guess, truth, lambda g, t: F.abs(g - t))
    gaps = gaps if valid is None else F.zip_with(gaps, valid, lambda x, v: F.when(v, x))

    def add(s: Column, x: Column) -> Column:
        return F.when(x.isNull(), s).otherwise(F.struct((s["l1"] + x).alias("l1"), (s["hits"] + F.when(x < close, 1).otherwise(0)).alias("hits"), (s["n"] + 1).alias("n")))

    return F.coalesce(F.aggregate(gaps, _nothing(), add), _nothing())


def step_sums(frames: DataFrame, keep: Sequence[str], guess: str = "guess", truth: str = "truth", past: str | None = "past", valid: Column | None = None, close: float = CLOSE) -> DataFrame:
    """(keep, step, l1, hits, n) of each frame's chunk of vectors; steps past the end and dimensions that are not valid count nothing."""
    columns = [F.col(guess).alias("g"), F.col(truth).alias("t"), *([F.col(past).alias("p")] if past else [])]

    def one(z: Column) -> Column:
        sums = _row_sums(z["g"], z["t"], valid, close)
        return F.when(F.coalesce(z["p"], F.lit(True)), _nothing()).otherwise(sums) if past else sums

    sums = F.transform(F.arrays_zip(*columns), one)
    return frames.select(*keep, F.posexplode(sums).alias("step", "s")).select(*keep, "step", "s.l1", "s.hits", "s.n")


def rates(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, l1, accuracy, n): sums over sums; groups in which nothing counts have 0."""
    n = F.greatest(F.sum("n"), F.lit(1))
    return sums.groupBy(*by).agg((F.sum("l1") / n).alias("l1"), (F.sum("hits") / n).alias("accuracy"), F.sum("n").alias("n"))


def horizon_curve(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors by how far ahead a step was predicted, over the frames that have it."""
    return rates(sums.where("n > 0"), [*by, "step"])


def mean_of_batches(sums: DataFrame, batch: str) -> DataFrame:
    """The plain mean over batches of each batch's rates, as a loop over batches reports it; -1 without any."""
    each = rates(sums, [batch])
    return each.agg(*(F.coalesce(F.avg(c), F.lit(-1.0)).alias(c) for c in ("l1", "accuracy")), F.count("*").alias("batches"))


def physical(chunk: Column, slots: Sequence[align.Slot], widths: dict[str, int], modes: dict[str, str], stats: dict[str, normalize.Stats]) -> Column:
    """A chunk of merged, normalised vectors in its own units: split into parts, each taken back by its normaliser, and merged again.

    Metrics of parts that are coded by tokens use the statistics of that space instead of the model's.
    """

    def rows(lines: Column) -> Column:
        def row(v: Column) -> Column:
            parts = align.split(v, slots, widths)
            return align.merge({k: normalize.vector(x, modes[k], stats[k], inverse=True, lines=lines[k]) for k, x in parts.items()}, slots)

        return F.transform(chunk, row)

    lines = F.struct(*(normalize.lines(modes[k], stats[k]).alias(k) for k in widths))
    return F.get(F.transform(F.array(lines), rows), F.lit(0))  # scales and offsets once a chunk


def part_rates(frames: DataFrame, parts: Sequence[tuple[str, int]], keep: Sequence[str] = (), guess: str = "guess", truth: str = "truth", past: str | None = "past", rule_parts: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """(keep, part, l1, binary): mean error of each part's dimensions, and for rule parts the share on the same side of the threshold; parts beyond the vectors are left out."""
    spans, named, at = [], [], 0
    for name, width in parts:
        for binary in [False, True][: 1 + (name in rule_parts)]:
            spans.append((at, width, binary))
            here = F.size(F.get(truth, F.lit(0))) >= at + width
            s = F.get("_sums", F.lit(len(named)))
            named.append(F.when(here, F.struct(F.lit(name).alias("part"), F.lit(binary).alias("_binary"), *(s[c].alias(c) for c in ("l1", "hits", "n")))))
        at += width
    # All parts of a frame in one pass over the frames, which come out of windows; only their sums leave the row.
    chunks = [F.col(c).cast("array<array<double>>") for c in (guess, truth)]
    none_past = F.transform(guess, lambda _: F.lit(False))
    summed = frames.withColumn("_sums", kernels.part_sums(spans, CLOSE, threshold)(*chunks, F.col(past) if past else none_past))
    sums = summed.select(*keep, F.inline(F.array(*named))).where("part is not null")
    each = rates(sums, [*keep, "part", "_binary"])
    value = lambda binary, c: F.max(F.when(F.col("_binary") == binary, F.col(c)))
    out = each.groupBy(*keep, "part").agg(value(False, "l1").alias("l1"), value(True, "accuracy").alias("binary"), value(False, "n").alias("n"))
    return out.where("n > 0").drop("n")


def periodic_metrics(sums: DataFrame, rank: str, group: str, prefix: str = "eval/action/") -> DataFrame:
    """(name, value): each rank's rates and number of samples merged (counts are added, the rest averaged over ranks), and under ``per_emb/`` the groups' rates of sums over all ranks."""
    each = rates(sums, [rank])
    pairs = lambda *xs: F.inline(F.array(*(F.struct(n.alias("name"), v.cast("double").alias("value")) for n, v in xs)))
    ranks = each.select(pairs((F.lit("fm_l1"), F.col("l1")), (F.lit("fm_acc"), F.col("accuracy")), (F.lit("meta/num_samples"), F.col("n"))))
    ranks = merge_payload(ranks, "name", "value").withColumn("name", F.concat(F.lit(prefix), "name"))
    named = lambda what: F.concat(F.lit("per_emb/"), F.col(group), F.lit(f"/{what}"))
    groups = rates(sums, [group]).where("n > 0").select(pairs((named("fm_l1"), F.col("l1")), (named("fm_acc"), F.col("accuracy"))))
    return ranks.unionByName(groups)
