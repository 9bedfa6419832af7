"""Serving operators on Structured Streaming, each with keyed state in ``transformWithState``.

Rows of a micro-batch are put in the order of their sequence number first; a
row whose number is not above the last one seen of its key is late and dropped.
State is bounded: a buffer's length, a chunk, the open steps of a chunk, or an
open batch.  It is kept until a row with ``reset`` (see :func:`history`), or,
with ``idle``, until the watermark of the ``event_time`` column is that much past
the key's last row: an event-time timer clears it, and a key that comes back starts
anew.  Event-time timers need no batches without data, so any trigger ends.
The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
A value is a number or a vector of numbers; a chunk is an array of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType


def _ordered(batches: Iterator[pd.DataFrame], order: str, last: int) -> pd.DataFrame:
    rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
    return rows[rows[order] > last].drop_duplicates(order)


def _value(x):
    """A number, or a vector as a list."""
    return [float(v) for v in x] if hasattr(x, "__len__") else float(x)


def _held(v) -> list[float]:
    """A value as state keeps it."""
    return v if isinstance(v, list) else [v]


def _kind(df: DataFrame, column: str, depth: int = 0) -> tuple[str, bool]:
    """(Spark type of the column's values, whether they are vectors) below ``depth`` arrays."""
    t = df.schema[column].dataType
    for _ in range(depth):
        t = t.elementType
    wide = isinstance(t, ArrayType)
    return ("array<double>" if wide else "double"), wide


def _milliseconds(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


class _Keyed(StatefulProcessor):
    """Runs ``function(key, rows, state)`` over a key's rows; ``state`` has ``exists``, ``get`` and ``update``."""

    def __init__(self, function: Callable, schema: str, event_time: str | None, idle: int | None):
        self.function, self.schema, self.event_time, self.idle = function, schema, event_time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    @property
    def exists(self) -> bool:
        return self.state.exists()

    @property
    def get(self) -> tuple:
        return self.state.get()

    def update(self, value: tuple) -> None:
        self.state.update(value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        yield from self.function(key, batches, self)
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(int(_milliseconds(b[self.event_time]).max()) for b in batches) + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, function: Callable, output: str, state: str, event_time: str | None, idle: timedelta | None) -> DataFrame:
    if idle is not None and event_time is None:
        raise ValueError("idle keys are known by an event_time column that has a watermark")
    wait = None if idle is None else int(idle.total_seconds() * 1000)
    return df.groupBy(key).transformWithStateInPandas(_Keyed(function, state, event_time, wait), output, "Append", "None" if idle is None else "EventTime")


def history(df: DataFrame, key: str, order: str, value: str, steps: int, event_time: str | None = None, idle: timedelta | None = None) -> DataFrame:
    """The last ``steps`` values at every row, oldest first; the first value fills what is missing; a row with ``reset`` true clears."""
    number, wide = _kind(df, value)

    def run(k, batches, state: _Keyed):
        last, kept = state.get if state.exists else (-1, [])
        held, out = [list(v) if wide else v[0] for v in kept], []
        for r in _ordered(batches, order, last).itertuples():
            if getattr(r, "reset", False):
                held = []
            v = _value(getattr(r, value))
            held = (held or [v] * (steps - 1))[-(steps - 1) :] + [v] if steps > 1 else [v]
            last = int(getattr(r, order))
            out.append((k[0], last, held))
        state.update((last, [_held(v) for v in held]))
        yield pd.DataFrame(out, columns=[key, order, "history"])

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, run, f"{key} {kind}, {order} long, history array<{number}>", "last long, held array<array<double>>", event_time, idle)


def chunk_cache(df: DataFrame, key: str, order: str, chunk: str, steps: int, event_time: str | None = None, idle: timedelta | None = None) -> DataFrame:
    """Serves ``steps`` rows of a chunk before the next chunk is taken; row 0 where the chunk is shorter."""
    number, wide = _kind(df, chunk, 1)

    def run(k, batches, state: _Keyed):
        last, kept, at = state.get if state.exists else (-1, [], 0)
        held, out = [list(v) if wide else v[0] for v in kept], []
        for r in _ordered(batches, order, last).itertuples():
            if not held or at >= steps:
                held, at = [_value(x) for x in getattr(r, chunk)], 0
            last = int(getattr(r, order))
            out.append((k[0], last, at, held[at] if at < len(held) else held[0]))
            at += 1
        state.update((last, [_held(v) for v in held], at))
        yield pd.DataFrame(out, columns=[key, order, "position", "served"])

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, run, f"{key} {kind}, {order} long, position long, served {number}", "last long, held array<array<double>>, at long", event_time, idle)


def ensemble(df: DataFrame, key: str, order: str, chunk: str, event_time: str | None = None, idle: timedelta | None = None) -> DataFrame:
    """At every row the mean of all predictions made so far for its own step, by component; steps behind are dropped."""
    number, wide = _kind(df, chunk, 1)

    def run(k, batches, state: _Keyed):
        last, steps, sums, votes = state.get if state.exists else (-1, [], [], [])
        open_ = {s: [list(a), n] for s, a, n in zip(steps, sums, votes)}
        out = []
        for r in _ordered(batches, order, last).itertuples():
            now = int(getattr(r, order))
            for j, x in enumerate(getattr(r, chunk)):
                v = _held(_value(x))
                slot = open_.setdefault(now + j, [[0.0] * len(v), 0])
                slot[0] = [a + b for a, b in zip(slot[0], v)]
                slot[1] += 1
            open_ = {s: v for s, v in open_.items() if s >= now}
            mean = [a / open_[now][1] for a in open_[now][0]]
            out.append((k[0], now, mean if wide else mean[0], open_[now][1]))
            last = now
        state.update((last, list(open_), [v[0] for v in open_.values()], [v[1] for v in open_.values()]))
        yield pd.DataFrame(out, columns=[key, order, "value", "votes"])

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, run, f"{key} {kind}, {order} long, value {number}, votes long", "last long, steps array<long>, sums array<array<double>>, votes array<long>", event_time, idle)


def sensor_sync(df: DataFrame, key: str, time: str, topic: str, value: str, clock: str, others: tuple[str, ...], depth: int = 80, depths: dict[str, int] | None = None, event_time: str | None = None, idle: timedelta | None = None) -> DataFrame:
    """At every message of the clock topic, the nearest of the last messages of each other topic, later ones on ties; nothing while a buffer is empty.

    A topic keeps ``depth`` messages, or its own number in ``depths``.
    """
    number, wide = _kind(df, value)

    def run(k, batches, state: _Keyed):
        names, times, values = state.get if state.exists else ([], [], [])
        rings: dict[str, list[tuple[int, list[float]]]] = {t: [] for t in others}
        for n, t, v in zip(names, times, values):
            rings[n].append((t, list(v)))
        rows = pd.concat(list(batches), ignore_index=True)
        rows["_clock"] = rows[topic] == clock
        shown = lambda v: v if wide else v[0]
        out = []
        for r in rows.sort_values([time, "_clock"], kind="stable").itertuples():
            t, name, v = int(getattr(r, time)), getattr(r, topic), _held(_value(getattr(r, value)))
            if name in rings:
                rings[name] = [*rings[name], (t, v)][-(depths or {}).get(name, depth) :]
            elif name == clock and all(rings.values()):
                nearest = [min(reversed(rings[o]), key=lambda m: abs(m[0] - t)) for o in others]
                out.append((k[0], t, shown(v), [shown(m[1]) for m in nearest]))
        flat = [(n, t, v) for n in others for t, v in rings[n]]
        state.update(([x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]))
        yield pd.DataFrame(out, columns=[key, time, "clock_value", "nearest"])

    kind = df.schema[key].dataType.simpleString()
    return _stateful(df, key, run, f"{key} {kind}, {time} long, clock_value {number}, nearest array<{number}>", "names array<string>, times array<long>, held array<array<double>>", event_time, idle)


class _Batcher(StatefulProcessor):
    """Gathers a server's requests; the timer of the open batch flushes it."""

    def __init__(self, key: str, arrival: str, tie: str, most: int, wait: int):
        self.names, self.arrival, self.tie, self.most, self.wait = [key, arrival, tie, "batch", "flushed"], arrival, tie, most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n long")
        self.open = handle.getListState("open", "at long, tie long")

    def _close(self, key, held: list[tuple[int, int]], flushed: int) -> list[tuple]:
        n = self.number.get()[0] if self.number.exists() else 0
        self.number.update((n + 1,))
        return [(key[0], at, tie, n, flushed) for at, tie in held]

    def _keep(self, held: list[tuple[int, int]]) -> None:
        """Writes the open batch back, with the timer of its end."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.open.put(held)
            self.handle.registerTimer(held[0][0] + self.wait)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(at), int(tie)) for at, tie in self.open.get()] if self.open.exists() else []
        new = pd.concat(list(rows), ignore_index=True)
        new["_at"] = _milliseconds(new[self.arrival])
        out = []
        for at, tie in new.sort_values(["_at", self.tie], kind="stable")[["_at", self.tie]].itertuples(index=False):
            if held and at >= held[0][0] + self.wait:
                out += self._close(key, held, held[0][0] + self.wait)
                held = []
            held.append((int(at), int(tie)))
            if len(held) == self.most:
                out += self._close(key, held, int(at))
                held = []
        self._keep(held)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(int(at), int(tie)) for at, tie in self.open.get()] if self.open.exists() else []
        due = held and held[0][0] + self.wait <= expiredTimerInfo.getExpiryTimeInMs()
        if due:
            self.open.clear()
        yield self._table(self._close(key, held, held[0][0] + self.wait) if due else [])

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names).astype({c: "int64" for c in self.names[1:]})

    def close(self) -> None:
        pass


def micro_batches(df: DataFrame, key: str, arrival: str, tie: str, most: int, wait: timedelta, late: str = "0 seconds") -> DataFrame:
    """(key, arrival, tie, batch, flushed) of requests as their batch is flushed: when it is full, or when its wait since the first request has passed.

    ``arrival`` is a timestamp; times come out in milliseconds.  A batch that no further request of its server ends is flushed by an
    event-time timer, once the watermark (``late`` behind the newest request of any server) passes its end.  Batches are those of
    :func:`epiframe.operators.serving.micro_batches` where requests come in the order of arrival.
    """
    kind = df.schema[key].dataType.simpleString()
    waits = int(wait.total_seconds() * 1000)
    rows = df.withWatermark(arrival, late).groupBy(key)
    return rows.transformWithStateInPandas(_Batcher(key, arrival, tie, most, waits), f"`{key}` {kind}, `{arrival}` long, `{tie}` long, batch long, flushed long", "Append", "EventTime")


def isolate_errors(batch: DataFrame, errors, good_sink, bad_sink) -> None:
    """For foreachBatch: rows without errors to one sink, the others with theirs to another."""
    marked = batch.withColumn("errors", errors).persist()
    try:
        good_sink(marked.where(F.size("errors") == 0).drop("errors"))
        bad_sink(marked.where(F.size("errors") > 0))
    finally:
        marked.unpersist()


def window_counts(df: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Event-time counts with a watermark (an addition of this engine)."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
