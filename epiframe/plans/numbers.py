"""Queries of normalisation, transforms, rotations and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import codes as C
from epiframe.functions import normalize as N
from epiframe.functions import rotations as R
from epiframe.functions import transforms as T
from epiframe.plans.registry import query, table
from epiframe.plans.windows import FRAMES_SQL, STEPS, frames

#: Statistics that the normalisation queries are given.
MIN, MAX, MEAN, STD, Q01, Q99 = 0.0, 200.0, 20.0, 15.0, 1.0, 90.0


def _stats() -> N.Stats:
    return N.Stats.fixed(MIN, MAX, MEAN, STD, Q01, Q99, q001=0.5, q999=120.0, q0001=0.25, q9999=150.0, q00001=0.125, q99999=180.0)



def _norm(mode):
    def run(spark, d):
        return table(spark, d, "events").select("event_id", F.round(N.forward(F.col("value"), mode, _stats()), 6).alias("y"))

    return run


def _clamped(x):
    return f"greatest(least({x}, 5), -5)"


def _range_sql(lo, hi):
    return f"(value * (2.0::DOUBLE / ({hi} - {lo})) + (-1 - (2.0::DOUBLE / ({hi} - {lo})) * {lo}))"


_UP, _DOWN = 0.075 * (Q99 - MEAN), 0.075 * (MEAN - Q01)
_TAIL = f"(CASE WHEN value > {Q99} THEN {Q99}::DOUBLE + {_UP}::DOUBLE * ln(1 + (value - {Q99}) / {_UP}::DOUBLE) WHEN value < {Q01} THEN {Q01}::DOUBLE - {_DOWN}::DOUBLE * ln(1 + ({Q01} - value) / {_DOWN}::DOUBLE) ELSE value END)"
for _name, _mode, _sql in (
    ("norm_zscore", "z-score", _clamped(f"((value - {MEAN}) / ({STD}::DOUBLE + 1e-8::DOUBLE))")),
    ("norm_minmax", "min/max", _clamped(_range_sql(MIN, MAX))),
    ("norm_q01q99", "q01/q99", _clamped(_range_sql(Q01, Q99))),
    ("norm_q001q999", "q001/q999", _clamped(_range_sql(0.5, 120.0))),
    ("norm_q0001q9999", "q0001/q9999", _clamped(_range_sql(0.25, 150.0))),
    ("norm_q00001q99999", "q00001/q99999", _clamped(_range_sql(0.125, 180.0))),
    ("norm_tanh", "tanh", f"tanh({_range_sql(MIN, MAX)})"),
    ("norm_const", "-10/50", _clamped(_range_sql(-10.0, 50.0))),
    ("norm_identity", "identity", f"greatest(least(value, {MAX}), {MIN})::DOUBLE"),
    ("norm_zscore_tail", "z-score-tail", _clamped(f"(({_TAIL} - {MEAN}) / ({STD}::DOUBLE + 1e-8::DOUBLE))")),
    ("norm_q01q99_tail", "q01/q99-tail", _clamped(_range_sql(Q01, Q99).replace("value", _TAIL))),
):
    query(f"SELECT event_id, round({_sql}, 6) AS y FROM events", name=_name)(_norm(_mode))


@query("""WITH s AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings) WHERE i <= 60 GROUP BY i)
SELECT vec_id, CAST(v.i AS BIGINT) AS dim, round(CASE WHEN s.m IS NULL THEN x ELSE greatest(least((x - m) / (s + 1e-8::DOUBLE), 5), -5) END, 5) AS y
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings) v LEFT JOIN s ON s.i = v.i""")
def norm_vector(spark, d):
    """Whole vectors by statistics of their first 60 dimensions; the last four pass through."""
    from epiframe.operators import statistics as S

    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = v.select(F.posexplode(F.slice("e", 1, 60)).alias("dim", "value"))
    s = S.moments(rows, ["dim"]).agg(F.array_sort(F.collect_list(F.struct("dim", "min", "max", "mean", "std"))).alias("s"))  # one row a dimension
    one = s.select(*(F.col(f"s.{c}").alias(c) for c in ("min", "max", "mean", "std")))
    y = v.crossJoin(F.broadcast(one)).select("vec_id", F.posexplode(N.vector(F.col("e"), "z-score", N.Stats.of(quantiles=()))).alias("dim", "y"))
    return y.select("vec_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("y", 5).alias("y"))


@query("SELECT event_id, round(value, 4) AS x FROM events")
def norm_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", F.round(N.backward(N.forward(F.col("value"), "q01/q99-tail", _stats()), "q01/q99-tail", _stats()), 4).alias("x"))


@query(f"SELECT event_id, greatest(least(value, {Q99}), {Q01})::DOUBLE AS clipped, greatest(least(value, {MEAN + 2 * STD}), {MEAN - 2 * STD})::DOUBLE AS pulled FROM events")
def guards(spark, d):
    return table(spark, d, "events").select("event_id", N.guard(F.col("value"), _stats()).alias("clipped"), N.guard(F.col("value"), _stats(), 2.0).alias("pulled"))


@query("SELECT event_id, round(asinh(value / (1.5 * 10.0)), 6) AS y FROM events")
def asinh_fwd(spark, d):
    return table(spark, d, "events").select("event_id", F.round(T.asinh_compress(F.col("value"), 10.0), 6).alias("y"))


@query(f"SELECT event_id, round({_TAIL}, 6) AS y FROM events")
def tail_fwd(spark, d):
    return table(spark, d, "events").select("event_id", F.round(N.compress_tails(F.col("value"), _stats()), 6).alias("y"))


@query("SELECT event_id, round(atan2(sin(value), cos(value)), 6) AS y FROM events")
def wrap_angle(spark, d):
    return table(spark, d, "events").select("event_id", F.round(T.wrap_angle(F.col("value")), 6).alias("y"))


@query("SELECT event_id, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS strict, CASE WHEN value >= 20 THEN 100.0 ELSE 0.0 END::DOUBLE AS client FROM events")
def binarize(spark, d):
    return table(spark, d, "events").select("event_id", T.binarize(F.col("value"), 20.0).alias("strict"), T.client_binarize(F.col("value"), 20.0).alias("client"))


@query(f"WITH {FRAMES_SQL}, z AS (SELECT event_id, step, value, first_value(value) OVER (PARTITION BY event_id ORDER BY step) AS s FROM c) SELECT event_id, CAST(step AS BIGINT) AS step, round(value - s, 6) AS d0, value AS d1 FROM z")
def relative_chunk(spark, d):
    """Chunks of (value, value): the first dimension relative to the state, the second left as it is."""
    e = frames(spark, d)
    c = e.select("event_id", "value", e.chunk("value", STEPS).alias("c"))
    rows = F.transform("c", lambda x: F.array(x, x))
    r = c.select("event_id", F.posexplode(T.relative(rows, F.array("value", "value"), -1, (0,))).alias("step", "v"))
    return r.select("event_id", F.col("step").cast("long").alias("step"), F.round(F.element_at("v", 1), 6).alias("d0"), F.element_at("v", 2).alias("d1"))


@query("SELECT event_id, round(2 * (value / 200.0) - 1, 6) AS unit, 1 - value AS flipped, round(-1 * 0.5 * value + 3, 6) AS affine FROM events")
def unit_maps(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(T.gripper_unit(v, 200.0), 6).alias("unit"), T.flip_gripper(v).alias("flipped"), F.round(T.affine_unit(v, -1.0, 0.5, 3.0), 6).alias("affine"))


_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def _vec(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


_Q1 = "q AS (SELECT vec_id, e, sqrt(e[1]*e[1] + e[2]*e[2] + e[3]*e[3] + e[4]*e[4]) AS n FROM v), u AS (SELECT vec_id, e, e[1]/n AS w, e[2]/n AS x, e[3]/n AS y, e[4]/n AS z FROM q)"
_M = {"m0": "1-2*(y*y+z*z)", "m1": "2*(x*y-z*w)", "m2": "2*(x*z+y*w)", "m3": "2*(x*y+z*w)", "m4": "1-2*(x*x+z*z)", "m5": "2*(y*z-x*w)", "m6": "2*(x*z-y*w)", "m7": "2*(y*z+x*w)", "m8": "1-2*(x*x+y*y)"}


@query(f"WITH {_VEC}, {_Q1} SELECT vec_id, " + ", ".join(f"round({x}, 6) + 0.0 AS {k}" for k, x in _M.items()) + " FROM u")
def quat_to_matrix(spark, d):
    m = _vec(spark, d).withColumn("m", R.to_matrix(R.unit(F.slice("e", 1, 4), 4)))
    return m.select("vec_id", *(F.round(F.element_at("m", i + 1), 6).alias(f"m{i}") for i in range(9)))


@query(f"WITH {_VEC}, {_Q1} SELECT vec_id, " + ", ".join(f"round(abs({c}), 6) AS a{c}" for c in "wxyz") + " FROM u")
def matrix_to_quat(spark, d):
    q = _vec(spark, d).withColumn("q", R.from_matrix(R.to_matrix(R.unit(F.slice("e", 1, 4), 4))))
    return q.select("vec_id", *(F.round(F.abs(F.element_at("q", i + 1)), 6).alias(f"a{c}") for i, c in enumerate("wxyz")))


@query(f"""WITH {_VEC} SELECT vec_id, round(e[1]*e[5] - e[2]*e[6] - e[3]*e[7] - e[4]*e[8], 6) AS w, round(e[1]*e[6] + e[2]*e[5] + e[3]*e[8] - e[4]*e[7], 6) AS x,
round(e[1]*e[7] - e[2]*e[8] + e[3]*e[5] + e[4]*e[6], 6) AS y, round(e[1]*e[8] + e[2]*e[7] - e[3]*e[6] + e[4]*e[5], 6) AS z FROM v""")
def quat_mul(spark, d):
    q = _vec(spark, d).withColumn("q", R.multiply(F.slice("e", 1, 4), F.slice("e", 5, 4)))
    return q.select("vec_id", *(F.round(F.element_at("q", i + 1), 6).alias(c) for i, c in enumerate("wxyz")))


@query(f"""WITH {_VEC}, a AS (SELECT vec_id, e, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]) AS n FROM v), b AS (SELECT *, e[1]/n AS a1, e[2]/n AS a2, e[3]/n AS a3 FROM a),
c AS (SELECT *, a1*e[4]+a2*e[5]+a3*e[6] AS p FROM b), g AS (SELECT *, e[4]-p*a1 AS g1, e[5]-p*a2 AS g2, e[6]-p*a3 AS g3 FROM c), h AS (SELECT *, sqrt(g1*g1+g2*g2+g3*g3) AS m FROM g)
SELECT vec_id, round(a1, 6) AS r0, round(a2, 6) AS r1, round(a3, 6) AS r2, round(g1/m, 6) AS r3, round(g2/m, 6) AS r4, round(g3/m, 6) AS r5,
round((a2*g3-a3*g2)/m, 6) AS r6, round((a3*g1-a1*g3)/m, 6) AS r7, round((a1*g2-a2*g1)/m, 6) AS r8 FROM h""")
def rot6d(spark, d):
    m = _vec(spark, d).withColumn("m", R.matrix_from_six(F.slice("e", 1, 6)))
    return m.select("vec_id", *(F.round(F.element_at("m", i + 1), 6).alias(f"r{i}") for i in range(9)))


@query(f"WITH {_VEC} SELECT vec_id, round(e[1], 6) AS a, round(e[2], 6) AS b, round(e[3], 6) AS c FROM v")
def euler_roundtrip(spark, d):
    m = _vec(spark, d).withColumn("a", R.matrix_to_euler(R.euler_to_matrix(F.slice("e", 1, 3), "XYZ"), "XYZ"))
    return m.select("vec_id", *(F.round(F.element_at("a", i + 1), 6).alias(c) for i, c in enumerate("abc")))


@query(f"WITH {_VEC}, {_Q1} SELECT vec_id, round(2 * acos(greatest(-1, least(1, w))) * x / sqrt(1 - w*w), 6) AS rx, round(2 * acos(greatest(-1, least(1, w))) * y / sqrt(1 - w*w), 6) AS ry, round(2 * acos(greatest(-1, least(1, w))) * z / sqrt(1 - w*w), 6) AS rz FROM u")
def axis_angle(spark, d):
    a = _vec(spark, d).withColumn("a", R.to_axis_angle(R.unit(F.slice("e", 1, 4), 4)))
    return a.select("vec_id", *(F.round(F.element_at("a", i + 1), 6).alias(c) for i, c in enumerate(("rx", "ry", "rz"))))


@query(f"WITH {_VEC} SELECT vec_id, round(e[1], 6) AS x, round(e[2], 6) AS y, round(e[3], 6) AS z FROM v")
def relative_pose_roundtrip(spark, d):
    p = _vec(spark, d).withColumns({"p": F.slice("e", 1, 7), "b": F.slice("e", 11, 7)})
    p = p.withColumn("r", R.absolute_pose(F.col("b"), R.relative_pose(F.col("b"), F.col("p"))))
    return p.select("vec_id", *(F.round(F.element_at("r", i + 1), 6).alias(c) for i, c in enumerate("xyz")))


@query(f"WITH {_VEC} SELECT vec_id, CAST(greatest(-1, least(floor((e[1] * 4 + 1) * 128), 255)) AS BIGINT) AS bin FROM v")
def proprio_bins(spark, d):
    return _vec(spark, d).select("vec_id", C.bin_unit(F.element_at("e", 1) * 4).alias("bin"))


@query(f"""WITH {_VEC}, k AS (SELECT unnest(range(0, 8)) AS k), i AS (SELECT unnest(range(0, 8)) AS i), b AS (SELECT unnest(range(0, 8)) AS b)
SELECT vec_id, CAST(b AS BIGINT) AS block, CAST(k AS BIGINT) AS k, round(sum(e[8 * b + i + 1] * (CASE WHEN k = 0 THEN sqrt(1/8.0::DOUBLE) ELSE sqrt(2/8.0::DOUBLE) END) * cos(pi() * (i + 0.5) * k / 8)), 6) AS c FROM v, k, i, b GROUP BY vec_id, b, k""")
def block_dct(spark, d):
    x = _vec(spark, d).select("vec_id", F.posexplode(C.block_dct(F.col("e"), 8)).alias("block", "b"))
    x = x.select("vec_id", "block", F.posexplode("b").alias("k", "c"))
    return x.select("vec_id", F.col("block").cast("long").alias("block"), F.col("k").cast("long").alias("k"), F.round("c", 6).alias("c"))


@query(f"WITH {_VEC} SELECT vec_id, CAST(CAST(round_even(2 * tanh(e[1] * 5), 0) AS BIGINT) + 2 + 5 * (CAST(round_even(2 * tanh(e[2] * 5), 0) AS BIGINT) + 2) + 25 * (CAST(round_even(tanh(e[3] * 5), 0) AS BIGINT) + 1) AS BIGINT) AS code FROM v")
def fsq_codes(spark, d):
    levels = (5, 5, 3)
    x = _vec(spark, d)
    return x.select("vec_id", C.fsq_code([C.fsq_level(F.element_at("e", i + 1) * 5, n) for i, n in enumerate(levels)], levels).alias("code"))


def _book(spark, d, lo, hi):
    rows = _vec(spark, d).where((F.col("vec_id") >= lo) & (F.col("vec_id") < hi)).orderBy("vec_id").collect()
    return [(r.vec_id, r.e) for r in rows]


_NEAR = "list_sum(list_transform(range(1, 65), lambda i: pow({a}[i] - b.e[i], 2)))"


@query(f"""WITH {_VEC}, m AS (SELECT v.vec_id, b.vec_id AS code, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_NEAR.format(a='v.e')}, b.vec_id) AS r FROM v, v b WHERE b.vec_id < 16)
SELECT vec_id, code FROM m WHERE r = 1""")
def nearest_code(spark, d):
    return C.nearest_code(_vec(spark, d), "e", _book(spark, d, 0, 16)).select("vec_id", "code")


@query(f"""WITH {_VEC}, m AS (SELECT v.vec_id, v.e, b.e AS be, b.vec_id AS code, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_NEAR.format(a='v.e')}, b.vec_id) AS r FROM v, v b WHERE b.vec_id < 16),
l AS (SELECT vec_id, code AS code0, list_transform(range(1, 65), lambda i: e[i] - be[i]) AS rest FROM m WHERE r = 1),
n AS (SELECT l.vec_id, code0, b.vec_id AS code1, row_number() OVER (PARTITION BY l.vec_id ORDER BY {_NEAR.format(a='l.rest')}, b.vec_id) AS r FROM l, v b WHERE b.vec_id BETWEEN 16 AND 31)
SELECT vec_id, code0, code1 FROM n WHERE r = 1""")
def residual_vq2(spark, d):
    return C.residual_codes(_vec(spark, d), "e", [_book(spark, d, 0, 16), _book(spark, d, 16, 32)]).select("vec_id", "code0", "code1")


@query("SELECT event_id, 1000 - greatest(0, least(CAST(floor(value) AS BIGINT), 99)) AS token FROM events")
def code_tokens(spark, d):
    return table(spark, d, "events").select("event_id", C.token_of_code(F.floor("value"), 1000, 100, descending=True).alias("token"))


@query("SELECT event_id, round(0.1 + (0.9 - 0.1) * least(greatest(event_id / 500.0, 0), 1), 6) AS linear, round(CASE WHEN event_id < 100 THEN 0.001 * event_id / 100 WHEN event_id < 200 THEN 0.001 ELSE 0.0001 + (0.001 - 0.0001) * 0.5 * (1 + cos(pi() * least((event_id - 200) / 800.0, 1))) END, 6) AS cosine FROM events")
def schedules(spark, d):
    s = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(T.linear_schedule(s, 0.1, 0.9, 500), 6).alias("linear"), F.round(T.cosine_schedule(s, 0.001, 0.0001, 100, 100, 1000), 6).alias("cosine"))


@query("""WITH p AS (SELECT p_partkey, p_size_h AS h, p_size_w AS w FROM (SELECT p_partkey, p_partkey % 900 + 30 AS p_size_h, p_partkey * 7 % 1100 + 30 AS p_size_w FROM part))
SELECT p_partkey, CAST(floor((h - floor(h * 0.9::DOUBLE)) / 2) AS BIGINT) AS top, CAST(floor(h * 0.9::DOUBLE) AS BIGINT) AS height,
CAST(greatest(28, round_even(h / 28.0::DOUBLE, 0) * 28) AS BIGINT) AS near_h FROM p""")
def image_sizes(spark, d):
    h = F.col("p_partkey") % 900 + 30
    top, _, height, _ = T.centre_crop(h, h, 0.9)
    near, _ = T.smart_size(h, h, 28, 1, 1 << 40)
    return table(spark, d, "part").select("p_partkey", top.cast("long").alias("top"), height.cast("long").alias("height"), near.alias("near_h"))


@query("""WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * CASE WHEN i = 1 THEN pow(0.7::DOUBLE, n - 1) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - i) END), 4) AS ema FROM f GROUP BY user_id""")
def ema(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    return e.select("user_id", F.round(T.ema(F.transform("l", lambda s: s["value"]), 0.3), 4).alias("ema"))


_POSE = {"r0": "1-s*(y*y+z*z)", "r1": "s*(x*y-z*w)", "r2": "s*(x*z+y*w)", "r3": "s*(x*y+z*w)", "r4": "1-s*(x*x+z*z)", "r5": "s*(y*z-x*w)"}


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e, e[4] AS x, e[5] AS y, e[6] AS z, e[7] AS w, 2 / (e[4]*e[4] + e[5]*e[5] + e[6]*e[6] + e[7]*e[7]) AS s FROM v) SELECT vec_id, round(e[1], 6) AS px, " + ", ".join(f"round({x}, 6) + 0.0 AS {k}" for k, x in _POSE.items()) + ", e[4] > 0 OR e[5] > 0 OR e[6] > 0 OR e[7] > 0 AS turns FROM p")
def pose_six(spark, d):
    """A quaternion pose as position and six components, and its mask."""
    p = _vec(spark, d).withColumns({"p": R.pose_to_six(F.slice("e", 1, 7)), "m": R.pose_mask_to_six(F.transform(F.slice("e", 1, 7), lambda x: x > 0))})
    return p.select("vec_id", F.round(F.element_at("p", 1), 6).alias("px"), *(F.round(F.element_at("p", i + 4), 6).alias(f"r{i}") for i in range(6)), F.element_at("m", 9).alias("turns"))


@query(f"WITH {_VEC} SELECT vec_id, round(e[1], 6) AS px, round(e[4], 6) AS a, round(e[5], 6) AS b, round(e[6], 6) AS c FROM v")
def euler_pose_round_trip(spark, d):
    p = _vec(spark, d).withColumn("p", R.quaternion_pose_to_euler(R.euler_pose_to_quaternion(F.slice("e", 1, 6))))
    return p.select("vec_id", F.round(F.element_at("p", 1), 6).alias("px"), *(F.round(F.element_at("p", i + 4), 6).alias(c) for i, c in enumerate("abc")))
