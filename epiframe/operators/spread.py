"""Orders within groups of any size: numbers, running sums and last known values, without a task that holds a whole group.

A table is cut into buckets of its (group, order) by literal bounds, so that a
bucket holds about ``BUCKET_ROWS`` rows whether these are one group or many.
What a row takes from earlier buckets of its group is carried by a table of one
row for each bucket and group: it is joined on both, which no group makes hot,
and the rest is a window inside the bucket.  Bucket and group are one struct, which
is never null (null groups are groups), so that join and window share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators.selection import order_bounds, order_bucket


class Spread:
    """A table in buckets of its (key, order); rows of equal (key, order) share a bucket.  ``within`` are columns that order rows further, inside a bucket only."""

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str], within: Sequence[str | Column] = (), buckets: int | None = None):
        self.columns, self.key = df.columns, list(key)
        bounds = order_bounds(df, [*key, *order], buckets)
        self.df = df.withColumn("_bucket", F.struct(order_bucket(bounds, [*key, *order]).alias("_number"), *key))
        self.by = Window.partitionBy("_bucket").orderBy(*order, *within)
        self.order = [*order, *within]

    def joined(self, ends: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """The rows with what is carried to their bucket: ``ends`` are aggregates of a bucket and group, ``carried`` are windows over these (see :attr:`earlier`)."""
        table = self.df.groupBy("_bucket").agg(*(a.alias(n) for n, a in ends.items())).select("_bucket", *(c.alias(n) for n, c in carried.items()))
        return self.df.join(table, "_bucket")

    @property
    def group(self):
        return Window.partitionBy(*(F.col("_bucket")[c] for c in self.key))

    @property
    def earlier(self):
        return self.group.orderBy(F.col("_bucket")["_number"]).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def later(self):
        return self.group.orderBy(F.col("_bucket")["_number"].desc()).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "frame_index", length: str | None = None, buckets: int | None = None) -> DataFrame:
    """Adds the 0-based place of a row in its group, and the group's number of rows."""
    s = Spread(df, key, order, buckets=buckets)
    rows = s.joined({"_n": F.count("*")}, {"_s": F.coalesce(F.sum("_n").over(s.earlier), F.lit(0)), "_len": F.sum("_n").over(s.group)})
    place = (F.col("_s") + F.row_number().over(s.by) - 1).alias(out)
    return rows.select(*s.columns, place, *([F.col("_len").alias(length)] if length else []))


def running_total(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Adds the sum of a whole number over a group's rows up to each row."""
    s = Spread(df, key, order, buckets=buckets)
    s.df = s.df.withColumn("_v", value)
    rows = s.joined({"_n": F.sum("_v")}, {"_s": F.coalesce(F.sum("_n").over(s.earlier), F.lit(0))})
    inside = F.coalesce(F.sum("_v").over(s.by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn(out, (F.col("_s") + inside).cast("long")).select(*s.columns, out)


def last_known(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Adds the last value that is not null at or before each row of its group."""
    s = Spread(df, key, order, buckets=buckets)
    s.df = s.df.withColumn("_v", value)
    rows = s.joined({"_e": F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*s.order)))}, {"_s": F.last("_e", ignorenulls=True).over(s.earlier)})
    inside = F.last("_v", ignorenulls=True).over(s.by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(inside, F.col("_s"))).select(*s.columns, out)


def neighbours(df: DataFrame, key: Sequence[str], time: str, value: Column, tie: Sequence[Column], before: str, after: str, buckets: int | None = None) -> DataFrame:
    """Adds the nearest values that are not null at or before, and at or after, each row in time; of several at one time the last before, and the first after, in the order of ``tie``.

    A row that has a value itself sees those of its own time only as far as it, in that order.
    """
    s = Spread(df, key, [time], buckets=buckets)
    names = [f"_t{i}" for i in range(len(tie))]
    s.df = s.df.withColumn("_v", value).withColumns(dict(zip(names, tie)))
    known, place = F.col("_v").isNotNull(), F.struct(time, *names)
    rows = s.joined(
        {"_last": F.max_by("_v", F.when(known, place)), "_first": F.min_by("_v", F.when(known, place))},
        {"_p": F.last("_last", ignorenulls=True).over(s.earlier), "_q": F.last("_first", ignorenulls=True).over(s.later)},
    )
    # A value and a row without one may share a time: values come first in the look back, and last in the look ahead.
    back = Window.partitionBy("_bucket").orderBy(F.col(time), F.col("_v").isNull(), *names).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_bucket").orderBy(F.col(time).desc(), F.col("_v").isNull(), *(F.col(n).desc() for n in names)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({before: F.coalesce(F.last("_v", ignorenulls=True).over(back), F.col("_p")), after: F.coalesce(F.last("_v", ignorenulls=True).over(ahead), F.col("_q"))})
    return rows.select(*s.columns, before, after)
