"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import dropped, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are linked to its smallest one; small star: its smaller neighbours and itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(low, "a")
    out = linked.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Edges with a null end or equal ends are ignored; repeated edges count once.
    Rounds grow with the logarithm of the longest path; each is written to the
    shared folder and the one before goes, so a lost executor costs one round at most.  Only one row of
    counts per round reaches the driver.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = staged(now, "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if mark == before:
            break
        before = mark
        old, now = now, staged(_star(_star(now, True), False), "edges")
        dropped(old)
    found = now.groupBy("a").agg(F.min("b").alias("b"))
    roots = found.select(F.col("b").alias("a"), F.col("b")).distinct()
    return found.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
