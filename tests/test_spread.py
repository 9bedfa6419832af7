"""Long groups in many tasks: blocks with halos, numbers, running sums and last values equal their one-window forms."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epiframe.operators import lookups, selection
from epiframe.operators.episodes import Episodes, runs
from epiframe.operators.spread import last_known, neighbours, numbered, running_total


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(4)
    lengths = {1: 400, 2: 1, 3: 37, None: 5, 4: 90}
    rows = [(k, t, rng.choice([None, *range(6)]), float(t % 7)) for k, n in lengths.items() for t in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k long, t long, x long, y double").repartition(5).cache()


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


WINDOWS = {
    "chunk": ((0, 9), lambda e: [e.chunk("x", 10), e.chunk_pad(10)]),
    "history": ((12, 0), lambda e: [e.history("x", 4, 4), e.shift("y", -12)]),
    "ahead": ((0, 30), lambda e: [e.shift("x", 30), e.frame_index()]),
    "both": ((3, 5), lambda e: [e.at_offsets("x", [-3, 5]), F.lag("x", 2).over(e.by), e.changed("x")]),
}


@pytest.mark.parametrize("size", [1, 16])
@pytest.mark.parametrize("name", sorted(WINDOWS))
def test_blocks_equal_whole_episodes(frames, name, size):
    (back, ahead), columns = WINDOWS[name]
    whole = Episodes(frames, ["k"], ["t"])
    cut = Episodes.spread(frames, ["k"], ["t"], back, ahead, rows=size)
    known = Episodes.spread(frames, ["k"], ["t"], back, ahead, rows=size, frame="t")
    want = rows(whole.select("k", "t", *columns(whole)))
    assert cut.blocked and rows(cut.select("k", "t", *columns(cut))) == want
    assert rows(known.select("k", "t", *columns(known))) == want


def test_blocks_do_not_know_an_episodes_length(frames):
    with pytest.raises(ValueError):
        Episodes.spread(frames, ["k"], ["t"], rows=10).length()
    assert not Episodes.spread(frames, ["k"], ["t"]).blocked


@pytest.mark.parametrize("buckets", [None, 60])
def test_orders_equal_one_window(frames, buckets):
    by = Window.partitionBy("k").orderBy("t")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy("k"))
    assert rows(numbered(frames, ["k"], ["t"], "i", "n", buckets)) == rows(frames.select("*", (F.row_number().over(by) - 1).alias("i"), n.alias("n")))
    assert rows(running_total(frames, ["k"], ["t"], F.col("x"), "s", buckets)) == rows(frames.select("*", F.coalesce(F.sum("x").over(upto), F.lit(0)).alias("s")))
    assert rows(last_known(frames, ["k"], ["t"], F.col("x"), "v", buckets)) == rows(frames.select("*", F.last("x", ignorenulls=True).over(upto).alias("v")))
    tied = frames.withColumn("h", F.floor(F.col("t") / 3))
    got = neighbours(tied, ["k"], "h", F.col("x"), [F.col("t")], "a", "z", buckets).select("k", "t", "a", "z")
    kept = tied.where("x is not null").select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("t").alias("t2"), F.col("x").alias("x2"))
    pairs = tied.join(kept, tied.k.eqNullSafe(kept.k2), "left")
    best = pairs.groupBy("k", "t").agg(F.max_by("x2", F.when(F.col("h2") <= F.col("h"), F.struct("h2", "t2"))).alias("a"), F.min_by("x2", F.when(F.col("h2") >= F.col("h"), F.struct("h2", "t2"))).alias("z"))
    empty = tied.where("x is null").select("k", "t")
    of = lambda df: rows(df.alias("l").join(empty.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.t") == F.col("r.t")), "left_semi"))
    assert of(got) == of(best)


@pytest.mark.parametrize("size", [8, 100])
def test_runs_equal_one_window(frames, size):
    e = Episodes(frames, ["k"], ["t"])
    changed = frames.withColumn("c", e.changed("x"))
    want = changed.withColumn("run", F.sum("c").over(e.by.rowsBetween(Window.unboundedPreceding, 0))).drop("c")
    assert rows(runs(frames, ["k"], ["t"], "x", rows=size)) == rows(want)


@pytest.mark.parametrize("buckets", [1, 25])
def test_nearest_latest_in_buckets(spark, buckets):
    rng = random.Random(8)
    left = [(i, rng.choice([0, 0, 0, 1, 2]), rng.randrange(300)) for i in range(300)]
    right = [(rng.choice([0, 0, 1]), rng.randrange(300), v) for v in range(80)]
    a, b = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v long")
    got = {r.id: r.near for r in lookups.nearest_latest(a, b, ["k"], "t", "v", "near", buckets).collect()}
    for i, k, t in left:
        of = [(u, v) for q, u, v in right if q == k]
        before, after = max((x for x in of if x[0] <= t), default=None), min((x for x in of if x[0] >= t), default=None)
        want = None if not of else after[1] if after and (not before or after[0] - t <= t - before[0]) else before[1]
        assert got[i] == want


@pytest.mark.parametrize("rest", ["keep", "drop", "pad"])
def test_rank_batches_in_buckets(frames, rest):
    one = selection.rank_batches(frames, "k", ["t"], 3, 4, rest)
    assert rows(selection.rank_batches(frames, "k", ["t"], 3, 4, rest, buckets=40).select(one.columns)) == rows(one)


def alone(plan):
    """Windows in the order of frames that have no block or bucket among their groups."""
    return [w for w in re.findall(r"windowspecdefinition\(([^)]*)", plan) if re.search(r"\bt#", w) and not re.search(r"_bucket#|_block#", w)]


def test_one_episode_of_ten_million_frames(spark):
    n, size = 10_000_000, 500_000
    long = spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias("t"), (F.col("id") % 1000).alias("x"))
    e = Episodes.spread(long, ["k"], ["t"], back=6, ahead=3, rows=size, frame="t")
    out = e.select("t", F.element_at(e.history("x", 3, 3), 1).alias("h"), F.element_at(e.chunk("x", 4), 4).alias("c"))
    got = out.agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("c").alias("c")).first()
    whole = n // 1000 * (999 * 1000 // 2)
    ends = sum(range(1000 - 6, 1000)), sum(range(3))
    assert tuple(got) == (n, whole - ends[0], whole - ends[1] + 3 * 999)
    assert e.df.groupBy("_block").count().agg(F.max("count")).first()[0] <= size + 9
    assert not alone(out._jdf.queryExecution().optimizedPlan().toString())


def test_plans_have_no_window_over_a_whole_group(frames):
    e = Episodes.spread(frames, ["k"], ["t"], 2, 2, rows=50)
    shifted = e.select("k", "t", e.shift("x", 2))
    made = [shifted, selection.rank_batches(frames, "k", ["t"], 2, 2, buckets=20), runs(frames, ["k"], ["t"], "x", rows=50)]
    for df in made:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"windowspecdefinition\((_bucket|k#\d+L?, _block|_block)", plan) and not alone(plan), plan


def test_a_chunk_is_one_window_that_is_shuffled_once(frames):
    e = Episodes.spread(frames, ["k"], ["t"], 0, 3, rows=50)
    plan = e.select("k", "t", e.chunk("x", 4).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.count("struct(v, x#") == 1, plan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 300])
def test_a_bucket_is_found_in_as_many_steps_as_bounds_need(spark, n):
    bounds = [F.struct(F.lit(10 * i).cast("long").alias("id")) for i in range(1, n + 1)]
    bucketed = spark.range(10 * n + 25).select("id", selection.order_bucket(bounds, ["id"]).alias("b"))
    assert all(r.b == min(r.id // 10, n) for r in bucketed.collect())
    plan = bucketed._jdf.queryExecution().optimizedPlan().toString()
    steps = re.findall(r"aggregate\(\[([\d,]+)\]", plan)
    assert [len(x.split(",")) for x in steps] == ([n.bit_length()] if n else [])


def test_join_and_window_of_a_bucket_share_a_shuffle(spark, frames):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = numbered(frames, ["k"], ["t"], "i", buckets=20)._jdf.queryExecution().sparkPlan().toString()
        executed = numbered(frames, ["k"], ["t"], "i", buckets=20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    # Rows by bucket, counts by bucket, counts by group, counts by bucket again.
    assert executed.count("Exchange hashpartitioning") <= 4 and executed.count("ENSURE_REQUIREMENTS") <= 4
