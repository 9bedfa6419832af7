"""Serving-side operators over recorded streams: chunk caches, ensembles, commands with hold, recorded trials."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators.spread import last_known, numbered, running_total


def chunk_cache(frames: DataFrame, key: str, order: Sequence[str], chunk: str, steps: int, out: str = "served") -> DataFrame:
    """What a cache serves: a new chunk every ``steps`` frames, its row ``position`` in between, row 0 if it is shorter."""
    f = numbered(frames, [key], order, "_i")
    f = f.withColumns({"request": F.floor(F.col("_i") / steps).cast("long"), "position": (F.col("_i") % steps).cast("long")})
    source = F.first(chunk).over(Window.partitionBy(key, "request").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("_c", source)
    at = F.when(F.col("position") < F.size("_c"), F.col("position")).otherwise(0).cast("int")
    return f.withColumn(out, F.element_at("_c", at + 1)).drop("_c", "_i")


def temporal_ensemble(predictions: DataFrame, key: str, step: str, chunk: str, out: str = "value") -> DataFrame:
    """Mean of all predictions of a step that were made at or before it."""
    long = predictions.select(key, F.col(step).alias("_from"), F.posexplode(chunk).alias("_j", "_v"))
    return long.groupBy(key, (F.col("_from") + F.col("_j")).alias("step")).agg(F.avg("_v").alias(out), F.count("*").alias("votes"))


def held_command(frames: DataFrame, key: str, order: Sequence[str], command: str, hold: str, out: str = "command") -> DataFrame:
    """The command, or the last one before it while ``hold`` is true."""
    said = F.when(~F.col(hold) & F.col(command).isNotNull(), F.col(command))
    return last_known(frames, [key], order, said, out)


def recordings(frames: DataFrame, key: str, order: Sequence[str], reset: str, out: str = "recording") -> DataFrame:
    """Number of the recording a frame belongs to: each reset starts one."""
    return running_total(frames, [key], order, F.when(F.col(reset), 1).otherwise(0), out)


def trial_plan(trials: DataFrame, trial: str, inits: int, environments: int) -> DataFrame:
    """Initial state and environment of each trial number, in turn."""
    return trials.withColumns({"init": (F.col(trial) % inits).cast("long"), "environment": (F.col(trial) % environments).cast("long")})


def replanned(frames: DataFrame, key: str, order: Sequence[str], chunk: str, horizon: int, replan: int, out: str = "served") -> DataFrame:
    """What a queue serves that asks again after ``replan`` steps of a chunk, or after all ``horizon`` if that is less."""
    return chunk_cache(frames, key, order, chunk, min(horizon, replan), out)


def ensemble_vectors(predictions: DataFrame, key: str, step: str, chunk: str, out: str = "value") -> DataFrame:
    """As :func:`temporal_ensemble` for chunks of vectors: the mean of each component."""
    long = predictions.select(key, F.col(step).alias("_from"), F.posexplode(chunk).alias("_j", "_row")).select(key, (F.col("_from") + F.col("_j")).alias("step"), F.posexplode("_row").alias("_d", "_v"))
    means = long.groupBy(key, "step", "_d").agg(F.avg("_v").alias("_m"), F.count("*").alias("_n"))
    rows = F.array_sort(F.collect_list(F.struct("_d", "_m")))  # one component each
    return means.groupBy(key, "step").agg(F.transform(rows, lambda r: r["_m"]).alias(out), F.max("_n").alias("votes"))


def gripper_decoded(x: Column, unit: bool) -> Column:
    """-1 (close) or 1 (open): of a number in [0, 1] by whether it is above a half, else by its sign (0 stays 0)."""
    return F.when(x <= 0.5, -1.0).otherwise(1.0) if unit else F.signum(x)


def micro_batches(requests: DataFrame, key: str, arrival: str, tie: str, most: int, wait: int) -> DataFrame:
    """Adds ``batch`` and ``flushed``: requests of a server in the order of arrival are gathered until there are ``most``, or ``wait`` has passed since the first.

    A request that comes at the end of the wait or later opens the next batch.  A batch is flushed when it is full, else at
    the end of its wait.  Batches of one server follow from one another, so each server is gone through by one task, holding
    one Arrow batch of its requests and the state of the open batch.
    """
    kind = requests.schema[key].dataType.simpleString()
    ordered = requests.select(key, F.col(arrival).cast("long").alias("_at"), F.col(tie).cast("long").alias("_tie"))
    placed = ordered.repartition(key).sortWithinPartitions(key, "_at", "_tie")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server, number, began, held = None, -1, 0, []

        def closed(flushed: int) -> list[tuple]:
            return [(server, at, t, number, flushed) for at, t in held]

        for rows in batches:
            out = []
            for k, at, t in rows.itertuples(index=False):
                if held and (k != server or at >= began + wait):
                    out += closed(began + wait)
                    held = []
                if k != server:
                    server, number = k, -1
                if not held:
                    number, began = number + 1, at
                held.append((at, t))
                if len(held) == most:
                    out += closed(at)
                    held = []
            if out:
                yield pd.DataFrame(out, columns=[key, "_at", "_tie", "batch", "flushed"])
        if held:
            yield pd.DataFrame(closed(began + wait), columns=[key, "_at", "_tie", "batch", "flushed"])

    out = placed.mapInPandas(gather, f"`{key}` {kind}, _at long, _tie long, batch long, flushed long")
    return out.withColumnsRenamed({"_at": arrival, "_tie": tie})
