import pytest
from pyspark.sql import functions as F

from epiframe.operators import evaluation as E


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(k, t, [float(t), float(10 * k)], k % 2) for k, n in ((1, 5), (2, 1), (3, 9)) for t in range(n)]
    df = spark.createDataFrame(rows, "k long, t long, x array<double>, g long")
    return E.with_truth(df, ["k"], ["t"], "x", 3).withColumn("guess", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.array(F.get("x", F.lit(0)), F.col("k") * 10.0 + j)))


def test_horizon_errors_leave_out_the_end(frames):
    got = {r.step: (r.l1, r.accuracy, r.n) for r in E.horizon_curve(E.step_sums(frames, [])).collect()}
    # Dimension 0 errs by the step, dimension 1 by the step as well; an episode of n frames has n - step of them.
    assert got == {0: (0.0, 1.0, 30), 1: (1.0, 0.0, 24), 2: (2.0, 0.0, 20)}


def test_dimensions_that_are_not_valid(frames):
    got = {r.step: r.n for r in E.horizon_curve(E.step_sums(frames, [], valid=F.array(F.lit(True), F.lit(False)))).collect()}
    assert got == {0: 15, 1: 12, 2: 10}
    none = E.step_sums(frames, [], valid=F.array(F.lit(False), F.lit(False)))
    assert E.rates(none, []).first().l1 == 0.0 and E.horizon_curve(none).count() == 0


def test_blocks_and_whole_episodes_agree(spark):
    df = spark.createDataFrame([(1, t, [float(t * t % 7)]) for t in range(50)], "k long, t long, x array<double>")
    a, b = (sorted(map(tuple, E.with_truth(df, ["k"], ["t"], "x", 6, rows=r).select("t", F.col("truth").cast("string"), "past").collect())) for r in (8, 1000))
    assert str(a) == str(b)


def test_mean_of_batches_is_plain(spark):
    sums = spark.createDataFrame([(0, 0, 4.0, 1, 4), (1, 0, 0.0, 1, 1), (2, 0, 0.0, 0, 0)], "b long, step long, l1 double, hits long, n long")
    assert tuple(E.mean_of_batches(sums, "b").first()) == (pytest.approx(1 / 3), pytest.approx(1.25 / 3), 3)
    assert tuple(E.mean_of_batches(sums.limit(0), "b").first()) == (-1.0, -1.0, 0)


def test_parts_beyond_the_vectors_are_left_out(frames):
    got = {r.part: (r.l1, r.binary) for r in E.part_rates(frames, [("a", 1), ("b", 1), ("c", 3)], rule_parts=["b"], threshold=15.0).collect()}
    assert set(got) == {"a", "b"} and got["a"][1] is None and got["b"][1] == 1.0


def test_last_step(spark):
    assert spark.range(1).select(E.last_step(F.array(F.lit(1), F.lit(5))).alias("x"), E.last_step(F.array().cast("array<int>")).alias("y")).first() == (5, None)


def test_all_parts_come_from_one_pass_over_the_frames(spark, sf, capsys):
    from epiframe.plans.registry import QUERIES

    QUERIES["open_loop_parts"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and plan.count("Generate") == 1 and plan.count("[sums(") == 1


def test_rule_parts_of_frames_without_a_group(spark):
    from pyspark.sql import functions as F

    from epiframe.operators import evaluation as E

    rows = spark.createDataFrame([(None, [[1.0, 0.0]], [[2.0, 1.0]]), ("x", [[1.0, 1.0]], [[1.0, 1.0]]), ("x", [[3.0]], [[1.0]])], "k string, guess array<array<double>>, truth array<array<double>>")
    out = E.part_rates(rows, [("a", 1), ("b", 1)], ["k"], past=None, rule_parts=["b"]).orderBy(F.col("k").asc_nulls_first(), "part").collect()
    assert [tuple(r) for r in out] == [(None, "a", 1.0, None), (None, "b", 1.0, 0.0), ("x", "a", 1.0, None), ("x", "b", 0.0, 1.0)]
