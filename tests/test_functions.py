import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epiframe.functions import align, codes, normalize, rotations, text, transforms
from epiframe.operators import lookups, samples, selection, serving, statistics
from epiframe.operators.episodes import Episodes


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=9, max_size=9))
def test_run_codec_roundtrip(bits):
    c = codes.RunCodec(9, 2, 5)
    fixed = c.repair(bits)
    assert c.valid(fixed)
    assert c.decode(c.encode(bits)) == fixed


def test_run_codec_counts_every_valid_sequence():
    c = codes.RunCodec(8, 2, 7)
    good = [list(b) for b in itertools.product((0, 1), repeat=8) if c.valid(b)]
    assert c.total == len(good)
    assert len({tuple(c.encode(b)) for b in good}) == len(good)


def numpy_wavelet(x, levels):
    low, high = map(np.array, codes._filters())
    details = []
    for _ in range(levels):
        x = np.append(x, x[-1]) if len(x) % 2 else x
        at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(8)) % len(x)
        details.append(x[at] @ high)
        x = x[at] @ low
    return [x, *details[::-1]]


@pytest.mark.parametrize("n", [1, 2, 7, 24, 64])
def test_wavelet_bands_energy_and_inverse(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    bands = codes.wavelet_bands(spark.createDataFrame([(x.tolist(),)], "v array<double>"), "v")
    got = bands.first()
    for i, want in enumerate(numpy_wavelet(x, 3)):
        assert got[f"band{i}"] == pytest.approx(want.tolist())
    if n in (24, 64):
        assert sum(bands.select(*(codes.wavelet_energy(F.col(f"band{i}")) for i in range(4))).first()) == pytest.approx((x**2).sum())
    low, high = codes.wavelet_split(F.col("v"))
    one_level = spark.createDataFrame([(x.tolist(),), ([],)], "v array<double>").select("v", codes.wavelet_join(low, high, F.size("v")).alias("w")).collect()
    assert all(r.w == pytest.approx(r.v) for r in one_level)


def test_dct_inverse(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    assert one(spark, codes.block_idct(codes.block_dct(F.col("v"), 4), 4), v=x) == pytest.approx(x)


def test_fsq_roundtrip(spark):
    levels = (8, 5)
    got = spark.range(40).select(*(c.alias(str(i)) for i, c in enumerate(codes.fsq_decode(F.col("id"), levels)))).distinct().count()
    assert got == 40


def test_kmeans_keeps_an_empty_cluster(spark):
    df = spark.createDataFrame([([0.0],), ([1.0],), ([2.0],)], "v array<double>")
    assert codes.kmeans(df, "v", [[0.5], [100.0]], 3) == [[1.0], [100.0]]


@pytest.mark.parametrize("mode", ["min/max", "q01/q99", "z-score", "tanh", "-3/7", "z-score-tail", "q01/q99-tail"])
def test_normalise_inverts(spark, mode):
    s = normalize.Stats.fixed(-2.0, 6.0, 1.0, 1.5, -1.0, 4.0)
    df = spark.createDataFrame([(x,) for x in (-1.5, 0.0, 3.9, 5.0)], "x double")
    for r in df.select("x", normalize.backward(normalize.forward(F.col("x"), mode, s), mode, s).alias("y")).collect():
        assert r.y == pytest.approx(r.x, abs=1e-5)


def test_normalise_edges(spark):
    flat = normalize.Stats.fixed(2.0, 2.0, 2.0, 0.0, 2.0, 2.0)
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(normalize.forward(F.col("x"), "z-score", flat)).collect()] == [0.0, 5.0, 0.0]
    assert [r[0] for r in df.select(normalize.forward(F.col("x"), "min/max", flat)).collect()] == [0.0, 5.0, 0.0]


@pytest.mark.parametrize("convention", ["XYZ", "ZYX", "XZY", "YXZ", "YZX", "ZXY", "XYX", "XZX", "YXY", "YZY", "ZXZ", "ZYZ"])
def test_euler_conventions(spark, convention):
    def axis(a, x):
        c, s = math.cos(x), math.sin(x)
        return np.array({"X": [[1, 0, 0], [0, c, -s], [0, s, c]], "Y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "Z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[a])

    angles = [0.3, 0.7, -1.1]
    m = axis(convention[0], 0.3) @ axis(convention[1], 0.7) @ axis(convention[2], -1.1)
    assert one(spark, rotations.euler_to_matrix(F.col("v"), convention), v=angles) == pytest.approx(m.ravel().tolist())
    assert one(spark, rotations.matrix_to_euler(rotations.euler_to_matrix(F.col("v"), convention), convention), v=angles) == pytest.approx(angles)


def test_rotation_forms(spark):
    q = [0.5, -0.5, 0.1, math.sqrt(0.49)]
    u = rotations.unit(F.col("q"), 4)
    six = rotations.from_matrix(rotations.matrix_from_six(rotations.six_from_matrix(rotations.to_matrix(u))))
    a, b = one(spark, rotations.standardize(six), q=q), one(spark, rotations.standardize(u), q=q)
    assert a == pytest.approx(b)
    assert one(spark, rotations.from_axis_angle(rotations.to_axis_angle(u)), q=q) == pytest.approx(one(spark, u, q=q))
    assert one(spark, rotations.to_axis_angle(F.col("q")), q=[1.0, 0.0, 0.0, 0.0]) == [0.0, 0.0, 0.0]


def test_relative_roundtrip(spark):
    t = transforms.RelativeJoint(("a",), {"a": F.array(F.lit(1.0), F.lit(2.0))}, (1,))
    parts = {"a": F.array(F.array(F.lit(5.0), F.lit(6.0))), "b": F.array(F.array(F.lit(1.0)))}
    out = t.forward(parts)
    assert spark.range(1).select(out["a"]).first()[0] == [[5.0, 4.0]]
    assert spark.range(1).select(t.backward(out)["a"], out["b"]).first()[0] == [[5.0, 6.0]]
    c = transforms.Concat(("x", "y"), (1, 2), "z")
    both = c.backward(c.forward({"x": F.array(F.lit(1.0)), "y": F.array(F.lit(2.0), F.lit(3.0))}))
    assert list(spark.range(1).select(both["x"], both["y"]).first()) == [[1.0], [2.0, 3.0]]


def test_step_limit(spark):
    assert one(spark, transforms.step_limited(F.array(F.lit(0.0), F.lit(0.0)), F.col("t"), 1.0), t=[4.0, -2.0]) == [1.0, -0.5]


def test_layout():
    slots = align.grouped_slots({"arm": ["l", "r"], "hand": ["h"]}, {"l": 3, "r": 5, "h": 1})
    assert align.layout(slots) == {"arm": (0, 5), "hand": (5, 6)} and align.total_width(slots) == 6
    assert align.check_layout([(0, 3), (3, 5)], 5) == []
    assert align.check_layout([(0, 3), (4, 6)], 5) == ["gap 3..4", "ends at 6, not 5"]


def test_merge_split(spark):
    slots = align.grouped_slots({"arm": ["l", "r"], "hand": ["h"]}, {"l": 2, "r": 3, "h": 1})
    df = spark.createDataFrame([([1.0, 2.0], None), (None, [4.0, 5.0, 6.0])], "l array<double>, r array<double>")
    merged = [r[0] for r in df.select(align.merge({"l": F.col("l"), "r": F.col("r")}, slots)).collect()]
    assert merged == [[1.0, 2.0, 0.0, 0.0], [4.0, 5.0, 6.0, 0.0]]
    back = align.split(align.merge({"l": F.col("l")}, slots), slots, {"l": 2})
    assert df.select(back["l"]).first()[0] == [1.0, 2.0]


def test_text(spark):
    assert one(spark, text.boxes_text(F.col("s")), s="{}") is None
    assert one(spark, text.boxes_text(F.col("s")), s="not json") is None
    t = '{"uv_left":[0.5,0.25],"visb_left":true,"uv_right":null,"visb_right":false}'
    assert one(spark, text.trace_text(F.col("s")), s=t) == "Trace: Left <loc0512><loc0256>; Right None"
    assert one(spark, text.valid_reasoning(F.col("s")), s="go go now") is False
    assert one(spark, text.valid_reasoning(F.col("s")), s="go to the cup") is True
    assert one(spark, text.last_number(F.col("s")), s="a\n1.5\n2\nx") == 2.0
    assert one(spark, text.clean_display(F.col("s")), s="a  <loc0001>|b <EOC>") == "a b"
    assert text.parse_template("<image_1> do <action!> <EOC>") == [("image", False, 1), ("action", True, None)]
    with pytest.raises(ValueError):
        text.parse_template("<EOC><EOC>")


@pytest.mark.parametrize("value,missing", [(None, True), ("NaN", True), (" none ", True), ("-1", True), ("0", False), ("x", False)])
def test_missing(spark, value, missing):
    assert one(spark, selection.is_missing(F.col("v").cast("string")), v=value) is missing


def test_windows_hold_nulls_and_edges(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (2, 0, 7.0)], "e int, t int, x double")
    w = Episodes(df, ["e"], ["t"])
    rows = {(r.e, r.t): r for r in df.select("e", "t", w.chunk("x", 3).alias("c"), w.shift("x", 1).alias("n"), w.shift("x", -1).alias("p"), w.history("x", 2).alias("h"), w.chunk_pad(2).alias("m")).collect()}
    assert rows[1, 0].c == [None, 5.0, 5.0] and rows[2, 0].c == [7.0, 7.0, 7.0]
    assert rows[1, 0].n == 5.0 and rows[1, 1].p is None and rows[2, 0].n == 7.0
    assert rows[1, 0].h == [None, None] and rows[1, 1].h == [None, 5.0]
    assert rows[1, 1].m == [False, True]


def test_floor_quantile_matches_sorting(spark):
    x = np.round(np.random.default_rng(3).normal(size=237), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    got = statistics.floor_quantiles(df, [], statistics.LOW + statistics.HIGH).first()
    for q in statistics.LOW + statistics.HIGH:
        assert got[statistics.quantile_name(q)] == np.sort(x)[int(q * (len(x) - 1))]


def test_permutation():
    for n in (1, 2, 7, 100):
        s = selection.coprime_stride(n)
        assert len({(i * s + 3) % n for i in range(n)}) == n
    assert statistics.even_places(11, 3) == [0, 5, 10]


def test_bad_weight_raises(spark):
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(statistics.effective_length(F.lit(3), F.lit(0.0))).collect()


def test_samples(spark, tmp_path):
    chunk = F.array(*(F.lit(float(i)) for i in range(4)))
    moved = [r[0] for r in spark.range(50).select(samples.time_shift(chunk, F.col("id"), 2)).distinct().collect()]
    assert sorted(moved) == [[0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 1.0, 2.0], [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 3.0], [2.0, 3.0, 3.0, 3.0]]
    k = [r[0][1] for r in spark.range(50).select(samples.amplitude(chunk, F.col("id"), 0.1)).collect()]
    assert 0.9 <= min(k) < max(k) <= 1.1
    t, l, m = samples.padded_sequence(F.array(F.lit(1).cast("long")), F.array(F.lit(2).cast("long")), 3, 0, -100)
    assert list(spark.range(1).select(t, l, m).first()) == [[1, 0, 0], [2, -100, -100], [True, False, False]]
    slots = samples.fill_slots(F.create_map(F.lit("a"), F.lit("x")), ["b", "a"], F.lit("none"))
    assert spark.range(1).select(slots).first()[0] == ["none", "x"]
    assert one(spark, text.resolve_tokens(F.col("s"), {"<a>": "A"}), s="<a>b<a>") == "AbA"
    assert samples.widths_seen(spark.createDataFrame([(1, [1]), (1, [1, 2])], "b int, v array<int>"), "b", "v").count() == 2
    for kind in ("csv", "json"):
        samples.write_results(spark.range(2), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        samples.write_results(spark.range(2), str(tmp_path / "x"), "xml")


def test_ranks_of_a_table_of_many_partitions_with_payload(spark):
    from pyspark.sql import Window

    df = spark.range(40_000).repartition(23).select(((F.col("id") * 7919) % 40_009).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("g"), F.repeat(F.lit("x"), 20).alias("payload"))
    got = selection.rank_rows(df, ["g", "k"], buckets=50)
    wrong = got.withColumn("want", F.row_number().over(Window.orderBy("g", "k")) - 1).where("want <> _rank").count()
    assert wrong == 0 and got.count() == 40_000 and got.columns == ["k", "g", "payload", "_rank"]


def test_ranks_of_an_empty_table(spark):
    assert selection.rank_rows(spark.range(0), ["id"], buckets=8).count() == 0


def test_ordinal_lookup_over_a_dictionary_of_many_partitions(spark):
    from epiframe.operators.lookups import decode_ordinal

    d = spark.range(20_000).repartition(21).select((F.col("id") * 3).alias("k"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = decode_ordinal(spark.range(20_000), "id", d, ["k"], "text", "out", buckets=40)
    assert got.where(F.col("out") == F.concat(F.lit("t"), F.col("id"))).count() == 20_000


def test_first_of_repeated_dictionary_entries(spark):
    from epiframe.operators.lookups import decode

    d = spark.createDataFrame([(1, 5, "b"), (1, 7, "a"), (2, 1, "c")], "k long, line long, text string")
    rows = decode(spark.range(1, 4), "id", d, "k", "text", "out", "none", order=["line"])
    assert sorted((r.id, r.out) for r in rows.collect()) == [(1, "b"), (2, "c"), (3, "none")]


def test_difference_of_keys_tells_null_from_absent(spark):
    a = spark.createDataFrame([("x", None), ("y", None), ("z", "1")], "k string, v string")
    b = spark.createDataFrame([("x", None), ("z", "1"), ("w", None)], "k string, v string")
    assert sorted(map(tuple, selection.key_diff(a, b, "k", "v").collect())) == [("w", "<MISSING>", None), ("y", None, "<MISSING>")]


@pytest.mark.parametrize("n", [1, 2, 7, 150, 9_999, 60_000])
@pytest.mark.parametrize("ties", [False, True])
def test_exact_quantiles(spark, n, ties):
    x = np.random.default_rng(n).normal(size=n)
    x = np.round(x, 1) if ties else x
    df = spark.createDataFrame([(float(v),) for v in x], "value double").repartition(5)
    qs = (0.00001, 0.001, 0.01, 0.5, 0.99, 0.99999)
    floor, linear = statistics.floor_quantiles(df, [], qs).first(), statistics.linear_quantiles(df, [], qs).first()
    s = np.sort(x)
    assert [floor[i] for i in range(len(qs))] == [s[int(q * (n - 1))] for q in qs]
    assert [linear[i] for i in range(len(qs))] == pytest.approx([np.quantile(x, q) for q in qs], abs=1e-12)
    assert abs((s <= statistics.approximate_quantiles(df, [], (0.5,)).first()[0]).mean() - 0.5) <= max(2 / n, 0.05)


def test_quantiles_of_groups_with_a_null_key_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None)], "g string, value double")
    got = {r.g: r.q5 for r in statistics.linear_quantiles(df, ["g"], (0.5,)).collect()}
    assert got == {None: 2.0, "a": 2.0}
    assert statistics.floor_quantiles(df.limit(0), ["g"], (0.5,)).count() == 0


@pytest.mark.parametrize("mode", ["q001/q999", "q0001/q9999", "q00001/q99999"])
def test_normalise_by_far_quantiles(spark, mode):
    s = normalize.Stats.fixed(-2.0, 6.0, 1.0, 1.5, -1.0, 4.0, q001=-1.5, q999=4.5, q0001=-1.8, q9999=5.0, q00001=-1.9, q99999=5.5)
    low, high = mode.split("/")
    df = spark.createDataFrame([(x,) for x in (-1.5, 0.0, 3.9, 5.0)], "x double")
    for r in df.select("x", normalize.forward(F.col("x"), mode, s).alias("y"), normalize.close(normalize.backward(normalize.forward(F.col("x"), mode, s), mode, s), F.col("x")).alias("ok")).collect():
        lo, hi = {"q001": -1.5, "q999": 4.5, "q0001": -1.8, "q9999": 5.0, "q00001": -1.9, "q99999": 5.5}[low], {"q999": 4.5, "q9999": 5.0, "q99999": 5.5}[high]
        assert r.y == pytest.approx(2 * (r.x - lo) / (hi - lo) - 1) and r.ok
    with pytest.raises(KeyError):
        normalize.forward(F.col("x"), mode, normalize.Stats.fixed(0, 1, 0, 1, 0, 1))


def test_normalise_chunks_by_steps(spark):
    lists = lambda v: F.array(*(F.array(*map(F.lit, r)) for r in v))
    s = normalize.Stats(lists([[0.0, 0.0]] * 3), lists([[2.0, 4.0]] * 3), lists([[1.0, 2.0], [2.0, 2.0], [0.0, 0.0]]), lists([[1.0, 2.0]] * 3))
    x = lists([[1.0, 4.0, 9.0], [1.0, 4.0, 9.0]])
    df = spark.range(1)
    assert [[pytest.approx(v) for v in r] for r in df.select(normalize.chunk(x, "z-score", s)).first()[0]] == [[0.0, 1.0, 9.0], [-1.0, 1.0, 9.0]]
    back = df.select(normalize.chunk(normalize.chunk(x, "min/max", s), "min/max", s, inverse=True)).first()[0]
    assert [v for r in back for v in r] == pytest.approx([1.0, 4.0, 9.0] * 2)
    with pytest.raises(Exception, match="3 steps for a chunk of 4"):
        df.select(normalize.chunk(lists([[1.0]] * 4), "z-score", s)).collect()


def test_normaliser_resolution():
    known = {"arm": {"global", "stepwise"}, "hand": {"global"}}
    find = lambda key, kind="action", **k: normalize.resolve(key, kind, "z-score", {"hand": "min/max"}, {"arm"}, known, **{"stepwise": True, **k})
    assert find("arm") == normalize.Resolved("z-score", True, False)
    assert find("hand", "state") == normalize.Resolved("min/max", False, True)
    assert find("hand", strict=False) == normalize.Resolved("identity", False, False)
    with pytest.raises(KeyError):
        find("hand")


def test_composite_transform(spark):
    unit = transforms.EachPart(("g",), lambda c: F.transform(c, lambda x: 2 * (x / 100.0) - 1), lambda c: F.transform(c, lambda x: (x + 1) * 50.0))
    t = transforms.Composite((unit, transforms.Concat(("g", "a"), (1, 2), "all")))
    df = spark.createDataFrame([([25.0], [1.0, 2.0])], "g array<double>, a array<double>")
    out = t.forward({"g": F.col("g"), "a": F.col("a")})
    assert df.select(out["all"]).first()[0] == [-0.5, 1.0, 2.0]
    back = t.backward(out)
    assert list(df.select(back["g"], back["a"]).first()) == [[25.0], [1.0, 2.0]] and t.invertible
    assert transforms.observation_tolerance(10) == pytest.approx(0.04)


def test_phase_rates_and_accumulated_means(spark):
    from epiframe.operators import metrics

    rows = spark.createDataFrame([("a", 1, None), ("a", 0, 1), ("b", 1, 1)], "task string, reach int, grasp int")
    assert {r.task: (r.reach, r.grasp) for r in metrics.phase_rates(rows, "task", ["reach", "grasp"]).collect()} == {"a": (0.5, 1.0), "b": (1.0, 1.0), "__overall__": (0.75, 1.0)}
    rows = spark.createDataFrame([(0, "acc", 1.0), (0, "acc", 0.0), (0, "other", 5.0), (0, "l1", None), (1, "acc", 1.0)], "step int, field string, value double")
    assert sorted(map(tuple, metrics.accumulated_means(rows, "step", "field", "value", ["acc", "l1"]).collect())) == [(0, "acc", 0.5), (1, "acc", 1.0)]


def test_micro_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(t), i) for s in ("x", "y", "z") for i, t in enumerate(rng.integers(0, 300, 80))]
    got = serving.micro_batches(spark.createDataFrame(rows, "server string, at long, id long").repartition(5), "server", "at", "id", 5, 20).collect()
    want = []
    for s in ("x", "y", "z"):
        number, held = -1, []
        for _, t, i in [*sorted(r for r in rows if r[0] == s), (s, 10**9, -1)]:
            if held and (t >= held[0][0] + 20 or len(held) == 5):
                want += [(s, a, b, number, held[-1][0] if len(held) == 5 else held[0][0] + 20) for a, b in held]
                held = []
            if not held:
                number += 1
            held.append((t, i))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_ensemble_of_vectors_and_gripper(spark):
    p = spark.createDataFrame([("e", 0, [[1.0, 2.0], [3.0, 4.0]]), ("e", 1, [[5.0, 8.0]])], "k string, i long, c array<array<double>>")
    assert {r.step: (r.value, r.votes) for r in serving.ensemble_vectors(p, "k", "i", "c").collect()} == {0: ([1.0, 2.0], 1), 1: ([4.0, 6.0], 2)}
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.6, -2.0)], "x double")
    assert [tuple(r) for r in df.select(serving.gripper_decoded(F.col("x"), True), serving.gripper_decoded(F.col("x"), False)).collect()] == [(-1.0, 0.0), (-1.0, 1.0), (1.0, 1.0), (-1.0, -1.0)]
    c = spark.createDataFrame([("e", i, [float(i), i + 0.5, i + 0.7]) for i in range(5)], "k string, i long, c array<double>")
    assert [r.served for r in serving.replanned(c, "k", ["i"], "c", 3, 2).orderBy("i").collect()] == [0.0, 0.5, 2.0, 2.5, 4.0]


def test_movement_by_norm_and_dims(spark):
    rows = [("e", i, [0.0, 0.3 * (i >= 2)], [0.4 * (i >= 2)]) for i in range(4)] + [("still", i, [1.0, 1.0], [1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i int, a array<double>, b array<double>")
    assert sorted((r.k, r.i) for r in selection.first_movement_of(df, "k", ["i"], ["a", "b"], 0.45).collect()) == [("e", 2), ("e", 3), ("still", 2)]
    c = F.lit([[1.0, 0.0], [1.5, 0.0], [9.0, 9.0], [9.0, 9.0]])
    assert spark.range(1).select(selection.active_dims(c, [0.5, 0.1], True), selection.active_dims(c, [0.5, 0.1], True, always=[1]), selection.constant_part(c, 0, 1, 0.5), selection.constant_part(c, 1, 1, 0.5)).first()[:] == ([True, False], [True, True], True, False)
    assert spark.range(1).select(selection.zero_inactive_dims(c, F.array(F.lit(True), F.lit(False)))).first()[0] == [[1.0, 0.0], [1.5, 0.0], [9.0, 0.0], [9.0, 0.0]]


def test_untested_helpers(spark):
    from epiframe.functions import arrays

    assert one(spark, arrays.pad_right(F.col("v"), 3), v=[1.0]) == [1.0, 0.0, 0.0]
    assert list(spark.range(1).select(*arrays.split_parts(F.lit([1.0, 2.0, 3.0]), (1, 2))).first()) == [[1.0], [2.0, 3.0]]
    assert one(spark, selection.all_active(2)) == [True, True]


def test_entry_without_the_training_data_folder(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "chunk_step_stats" in e.queries() and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.oracle_sql()


def test_plan_step_keeps_digits_of_its_line(spark):
    df = spark.createDataFrame([("0. pick\n1. place 21\n2. go", 1)], "plan string, n long")
    assert df.select(text.plan_step(F.col("plan"), F.col("n"))).first()[0] == "1. place 21"


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_when_the_bounds_are_wrong(spark, monkeypatch, by):
    """Bounds that miss their places: the groups are sorted whole, with the same values."""
    rng = np.random.default_rng(12)
    rows = [(g, float(x)) for g, n in ((0, 900), (1, 3), (None, 400)) for x in np.round(rng.normal(size=n), 1)]
    df = spark.createDataFrame([*rows, (2, None)], "g long, value double")
    qs = [0.01, 0.25, 0.9]
    shown = lambda out: sorted(map(str, (tuple(r) for r in out.collect())))
    want = [shown(f(df, by, qs)) for f in (statistics.floor_quantiles, statistics.linear_quantiles)] + [shown(statistics.step_statistics(df, by, quantiles=qs).drop("mean", "std"))]
    monkeypatch.setattr(statistics, "ACCURACY", 8)
    sketched = statistics._sketched

    def wrong(*args):
        sketch, few, wanted = sketched(*args)
        return sketch.withColumn("_s", F.transform("_s", lambda x: x - 100)), few, wanted

    monkeypatch.setattr(statistics, "_sketched", wrong)
    assert [shown(f(df, by, qs)) for f in (statistics.floor_quantiles, statistics.linear_quantiles)] + [shown(statistics.step_statistics(df, by, quantiles=qs).drop("mean", "std"))] == want
    x = np.sort([v for g, v in rows if by == [] or g == 0])
    assert statistics.floor_quantiles(df.where("g = 0") if by else df, by, qs).first()["q25"] == x[int(0.25 * (len(x) - 1))]


def test_collated_trees(spark):
    from epiframe.operators import samples

    rows = [(0, 1, ([1.0, 2.0], ("a", [1])), "m1"), (0, 0, ([3.0, 4.0], ("b", [1, 2])), "m0"), (1, 0, ([5.0], ("c", None)), None)]
    df = spark.createDataFrame(rows, "b long, t long, x struct<action:array<double>,deep:struct<task:string,gt:array<long>>>, meta string")
    got = {r.b: r for r in samples.collate_tree(df, "b", ["t"], ["meta"]).collect()}
    assert got[0]["x.action"] == [[3.0, 4.0], [1.0, 2.0]] and got[0]["x.deep.task"] == ["b", "a"] and [m.meta for m in got[0].metadata] == ["m0", "m1"]
    assert got[0].unstackable == ["x.deep.gt"] and got[1].unstackable == []
    assert samples.collate_tree(df, "b", ["t"], ragged=["x.deep.gt"]).where("b = 0").first().unstackable == []
    parts = spark.createDataFrame([(1, [[1.0]], [7]), (0, [[2.0], [3.0]], None)], "i long, arm array<array<double>>, n array<long>")
    assert tuple(samples.concat_batches(parts, [], ["i"], ["arm", "n"]).first()) == ([[2.0], [3.0], [1.0]], [7])


def test_observation_errors(spark):
    df = spark.createDataFrame([([[1.0, 2.0]], [1.0], "go", 3), ([[1.0]], None, None, 3)], "s array<array<double>>, v array<float>, task string, n int")
    errors, warnings = selection.observation_errors(df, {"s": (2, 2, "double"), "v": (1, 1, "double"), "n": (1, None, "int"), "gone": (1, 1, "double")}, ["task", "plan"])
    got = [r[0] for r in df.select(errors).collect()]
    every = ["n: rank 0, not 1", "gone: missing", "plan: not a text"]
    assert got[0] == every and got[1] == ["s: width is not 2", "v: null", every[0], every[1], "task: null", every[2]]
    assert warnings == ["v: float, expected double"]


def test_processor_configurations():
    from epiframe import spec

    per = {"a": {"norm": "z", "merger": {"x": 1}, "action_state_merger": {"old": 1}, "kind": "own"}, "b": {"norm": "q"}}
    got = spec.processors({"s1": "a", "s2": "b", "s3": "a"}, per, {"merger": {"y": 2}, "action_state_merger": {"new": 1}, "kind": "base"}, {"steps": 1}, own=["kind"])
    assert got["a"] == {"norm": "z", "merger": {"x": 1, "y": 2}, "action_state_merger": {"new": 1}, "kind": "own", "steps": 1, "embodiment_type": "a"}
    assert got["b"]["kind"] == "base"
    with pytest.raises(ValueError, match="extra: \\['b'\\]"):
        spec.processors({"s": "a"}, per)
    assert spec.equal_sources([("s", "a", {"x": 1}), ("t", "a", {"x": 1})]) == {"a": {"x": 1}}
    with pytest.raises(ValueError):
        spec.equal_sources([("s", "a", {"x": 1}), ("t", "a", {"x": 2})])
    bad = {"model": {"tokenizer": {"vq_config": {"ckpt_dir": "/none", "max_action_shape_meta": {"arm": 6, "hand": 1}}}, "model_arch": {"action_dim": 8}}}
    with pytest.raises(ValueError, match="does not exist.*is not 7"):
        spec.consistent(bad, lambda _: False)
    bad["model"]["model_arch"]["action_dim"] = 7
    spec.consistent(bad, lambda _: True)
    assert spec.map_leaves({"a": {"b": 1}, "c": 2}, lambda x: x + 1) == {"a": {"b": 2}, "c": 3}


def test_helpers_that_had_no_test(spark):
    from epiframe import spec
    from epiframe.functions import align, text
    from epiframe.operators import samples

    assert spec.passes_through(["a", "observation.x", "action", "note"], ["a"]) == ["note"]
    row = spark.range(1).select(
        text.key_values(F.lit("a=1,b=2")).alias("kv"),
        text.points_text(F.lit("cup"), F.array(F.lit(-1.0), F.lit(0.5))).alias("hidden"),
        selection.oversample_index(F.lit(7), 3).alias("over"),
        align.fill_absent(F.create_map(F.lit("arm"), F.array(F.lit(1.0))), [("arm", 1), ("leg", 2)]).alias("filled"),
    ).first()
    assert row.kv == {"a": "1", "b": "2"} and row.hidden == "cup: Not visible" and row.over == 1 and row.filled == {"arm": [1.0], "leg": [0.0, 0.0]}


def test_ranges_of_any_length(spark):
    rng = np.random.default_rng(11)
    starts = rng.integers(-10**6, 10**6, 60)
    ranges = [(i, int(a), int(a) + int(10 ** rng.uniform(0, 9))) for i, a in enumerate(starts)] + [(90, 0, 10**9), (91, 5, 5), (92, None, 7), (93, 7, 1)]
    points = [(int(p),) for p in rng.integers(-10**6, 10**8, 300)] + [(5,), (0,)]
    df = lookups.in_range(spark.createDataFrame(points, "p long"), "p", spark.createDataFrame(ranges, "id long, a long, b long"), "a", "b", 1000)
    want = sorted((p, i) for (p,) in points for i, a, b in ranges if a is not None and a <= p < b)
    assert sorted((r.p, r.id) for r in df.collect()) == want
