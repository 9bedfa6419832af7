"""Windows over episodes: forward chunks, histories, shifts and bounds that never cross an episode's ends.

Every function takes a frame DataFrame, its episode ``key`` columns and its
``order`` columns (a total order within an episode), and adds columns.  All of
them share one window specification, so Spark plans one exchange and one sort
for any number of them.  Frames are bounded by the chunk or history length:
memory does not grow with an episode.

Long episodes are cut into blocks of frames (:meth:`Episodes.spread`): a block
gets copies of the frames before and behind it that its windows reach, so one
episode is many tasks and its windows are the same expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators.selection import order_bounds, order_bucket
from epiframe.operators.spread import numbered, running_total

#: Own frames of a block; a table of no more rows is not cut.
BLOCK_ROWS = 250_000


class Episodes:
    """A frame table with its episode key and frame order."""

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str]):
        self.df, self.key, self.order = df, list(key), list(order)
        self._windows(self.key, self.order)
        self.blocked = False

    def _windows(self, key: Sequence[str], order: Sequence[str]) -> None:
        self.by = Window.partitionBy(*key).orderBy(*order)
        self.whole = self.by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @classmethod
    def spread(cls, df: DataFrame, key: Sequence[str], order: Sequence[str], back: int = 0, ahead: int = 0, rows: int = BLOCK_ROWS, frame: str | None = None) -> Episodes:
        """Episodes whose windows reach ``back`` frames before and ``ahead`` behind a frame, cut into blocks of ``rows`` frames.

        ``frame`` names a column with the 0-based place of a frame in its episode; without it frames are numbered first
        (one more shuffle).  Windows beyond the reach are wrong on blocks; take frames with :meth:`select`, which leaves
        the copies out.  A frame is copied to at most two more blocks, as a block is no shorter than the reach.
        """
        n = df.count()
        if n <= rows:
            return cls(df, key, order)
        e = cls.__new__(cls)
        e.key, e.order, e.blocked = list(key), list(order), True
        placed = df.withColumn("_frame", F.col(frame)) if frame else numbered(df, key, order, "_frame", buckets=n // rows + 1)
        rows = max(rows, back + ahead)
        at = F.col("_frame")
        near = F.sequence(F.floor(F.greatest(at - ahead, F.lit(0)) / rows), F.floor((at + back) / rows))
        e.df = placed.withColumn("_block", F.explode(near)).withColumn("_own", F.floor(at / rows) == F.col("_block"))
        e._windows([*key, "_block"], ["_frame"])
        return e

    def select(self, *columns: Column | str) -> DataFrame:
        """Columns of every frame, windows among them."""
        return self.df.select(*columns, F.col("_own")).where("_own").drop("_own") if self.blocked else self.df.select(*columns)

    def frame_index(self) -> Column:
        """0-based place in the episode."""
        return F.col("_frame") if self.blocked else F.row_number().over(self.by) - 1

    def length(self) -> Column:
        """Frames of the episode; not on blocks, see :func:`epiframe.operators.spread.numbered`."""
        if self.blocked:
            raise ValueError("a block does not see its whole episode")
        return F.count("*").over(self.whole)

    def first(self, c: str) -> Column:
        return F.first(c).over(self.whole)

    def last(self, c: str) -> Column:
        return F.last(c).over(self.whole)

    def shift(self, c: str, by: int) -> Column:
        """The value ``by`` frames later (earlier if negative), held at the episode's ends; null values stay null."""
        inside = F.struct(F.col(c).alias("v"))
        moved = F.lead(inside, by).over(self.by) if by >= 0 else F.lag(inside, -by).over(self.by)
        edge = F.last(inside) if by >= 0 else F.first(inside)
        return F.coalesce(moved, edge.over(self.whole))["v"]

    def at_offsets(self, c: str, offsets: Sequence[int]) -> Column:
        """Values at several offsets, each held at the episode's ends, as one array; a frame holds only the values it asks for."""
        return F.array(*(self.shift(c, o) for o in offsets))

    def chunk(self, c: str, steps: int) -> Column:
        """The next ``steps`` values from this frame on, the last repeated past the end."""
        seen = F.collect_list(F.struct(F.col(c).alias("v"))).over(self.by.rowsBetween(0, steps - 1))
        held = lambda s: F.concat(s["v"], F.array_repeat(F.element_at(s, -1)["v"], F.lit(steps) - F.size(s)))
        return F.get(F.transform(F.array(seen), held), F.lit(0))  # named, so that the window is one, not one for each use

    def chunk_pad(self, steps: int) -> Column:
        """For each step of a chunk whether it lies past the end."""
        left = F.count("*").over(self.by.rowsBetween(0, steps - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: j >= left)

    def history(self, c: str, steps: int, stride: int = 1) -> Column:
        """``steps`` values up to this frame, ``stride`` frames apart, oldest first, held at the start."""
        return self.at_offsets(c, [-k * stride for k in range(steps - 1, -1, -1)])

    def changed(self, c: str) -> Column:
        """1 where the value differs from the frame before, else 0; its running sum numbers the runs of equal values."""
        before = F.lag(F.struct(F.col(c).alias("v"))).over(self.by)
        return F.when(before.isNotNull() & ~before["v"].eqNullSafe(F.col(c)), 1).otherwise(0)


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str], c: str, out: str = "run", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the number of a frame's run of equal values in its episode."""
    e = Episodes.spread(df, key, order, back=1, rows=rows)
    changed = e.select(*df.columns, e.changed(c).alias("_changed"))
    return running_total(changed, key, order, F.col("_changed"), out, None if rows == BLOCK_ROWS else df.count() // rows + 1).drop("_changed")


def seconds_to_frames(seconds: Column, fps: Column | float) -> Column:
    """Offset in frames, halves to even."""
    return F.bround(seconds * fps).cast("long")


def history_stride(seconds: float, fps: float) -> int:
    return max(1, round(seconds * fps))


def task_masked_chunk(chunk: str, tasks: str) -> tuple[Column, Column]:
    """(chunk, padded): steps whose task differs from step 0's are padded and take the value of the last step that has it."""
    task = F.col(tasks)
    same = F.transform(task, lambda t: t.eqNullSafe(F.element_at(task, 1)))
    last = F.array_max(F.transform(same, lambda s, i: F.when(s, i + 1).otherwise(0)))
    value = F.transform(F.col(chunk), lambda v, i: F.when(F.element_at(same, i + 1), v).otherwise(F.element_at(F.col(chunk), last)))
    return value, F.transform(same, lambda s: ~s)


def explode_steps(df: DataFrame, chunk: str, step: str = "step", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One row per step of a chunk."""
    return df.select(*keep, F.posexplode(chunk).alias(step, value))


def episode_table(df: DataFrame, key: str) -> DataFrame:
    """(key, length, from_index, to_index): global frame ranges in key order.

    The running sum goes over one row per episode.  Episodes are summed in
    ranges of keys first, so no task sees all of them.
    """
    lengths = df.groupBy(key).agg(F.count("*").alias("length"))
    return with_offsets(lengths, key, "length")


def with_offsets(rows: DataFrame, key: str, size: str, start: str = "from_index", end: str = "to_index", buckets: int | None = None) -> DataFrame:
    """Running totals of ``size`` in the order of a unique ``key``: buckets of its order are summed, then their starts are added."""
    bounds = order_bounds(rows, [key], buckets)
    bucket = order_bucket(bounds, [key])
    sums = rows.select(bucket.alias("_b"), size).groupBy("_b").agg(F.sum(size).alias("_n"))
    before = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.sum(size).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_b", bucket).join(F.broadcast(before), "_b")  # one row a bucket
        .withColumn(end, (F.col("_start") + inside).cast("long"))
        .withColumn(start, (F.col(end) - F.col(size)).cast("long"))
        .drop("_b", "_start")
    )
