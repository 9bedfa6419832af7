"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.operators import statistics as S
from epiframe.operators.episodes import explode_steps
from epiframe.operators.spread import numbered
from epiframe.plans.registry import query, table
from epiframe.plans.windows import FRAMES_SQL, KEY, ORDER, STEPS, events, frames


def _long(spark, d):
    e = frames(spark, d)
    return explode_steps(e.select(e.chunk("value", STEPS).alias("c")), "c")


def _rounded(df, keep, values):
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in values))


_Q = "max(CASE WHEN k = CAST(floor({q} * (n - 1)) AS BIGINT) THEN value END) AS {name}"
_STEPS_SQL = f"""WITH {FRAMES_SQL}, r AS (SELECT step, value, row_number() OVER (PARTITION BY step ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY step) AS n FROM c),
st AS (SELECT CAST(step AS BIGINT) AS step, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
{_Q.format(q='CAST(0.01 AS DOUBLE)', name='q01')}, {_Q.format(q='CAST(0.99 AS DOUBLE)', name='q99')} FROM r GROUP BY step) """


@query(_STEPS_SQL + "SELECT step, n, min, max, round(mean, 6) AS mean, round(std, 6) AS std, q01, q99 FROM st")
def chunk_step_stats(spark, d):
    s = S.step_statistics(_long(spark, d), ["step"], quantiles=(0.01, 0.99))
    return s.select(F.col("step").cast("long").alias("step"), "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "q01", "q99")


@query(_STEPS_SQL + "SELECT min(min) AS min, max(max) AS max, round(avg(mean), 6) AS mean, round(sqrt(avg(std * std) + var_samp(mean)), 6) AS std, min(q01) AS q01, max(q99) AS q99 FROM st")
def global_from_stepwise(spark, d):
    s = S.step_statistics(_long(spark, d), ["step"], quantiles=(0.01, 0.99))
    return _rounded(S.global_from_steps(s, [], ["q01"], ["q99"]), ["min", "max", "q01", "q99"], ["mean", "std"])


@query("SELECT count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events")
def state_stats(spark, d):
    return _rounded(S.moments(table(spark, d, "events"), []), ["n", "min", "max"], ["mean", "std"])


@query("""WITH f AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM f WHERE i % 4 = 0""")
def state_stats_downsampled(spark, d):
    return _rounded(S.moments(numbered(events(spark, d), KEY, ORDER, "i").where("i % 4 = 0"), []), ["n", "min", "max"], ["mean", "std"])


@query(f"""WITH {FRAMES_SQL} SELECT CAST(step AS BIGINT) AS step, count(*) AS n, round(min(value - v0), 6) AS min, round(max(value - v0), 6) AS max, round(avg(value - v0), 6) AS mean, round(stddev_samp(value - v0), 6) AS std
FROM (SELECT *, first_value(value) OVER (PARTITION BY event_id ORDER BY step) AS v0 FROM c) GROUP BY step""")
def transformed_step_stats(spark, d):
    """Statistics of chunks relative to their first value."""
    e = frames(spark, d)
    c = e.select(F.transform(e.chunk("value", STEPS), lambda x: F.array(x)).alias("c"))
    first = F.get(F.get("c", F.lit(0)), F.lit(0))
    s = S.transformed_steps(c, F.col("c"), lambda chunk: F.transform(chunk, lambda row: F.transform(row, lambda x: x - first)), quantiles=(0.01,))
    return s.select(F.col("step").cast("long").alias("step"), "n", *(F.round(x, 6).alias(x) for x in ("min", "max", "mean", "std")))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, """ + ", ".join(_Q.format(q=f"CAST({q} AS DOUBLE)", name=S.quantile_name(q)) for q in (*S.LOW, *S.HIGH)) + " FROM r GROUP BY event_type")
def floor_quantiles(spark, d):
    return S.floor_quantiles(table(spark, d, "events"), ["event_type"], (*S.LOW, *S.HIGH))


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY event_type")
def linear_quantiles(spark, d):
    return _rounded(S.linear_quantiles(table(spark, d, "events"), ["event_type"], (0.01, 0.99)), ["event_type"], ["q01", "q99"])


@query("SELECT user_id, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id")
def episode_stats(spark, d):
    return _rounded(S.moments(table(spark, d, "events"), ["user_id"], population=True), ["user_id", "n", "min", "max"], ["mean", "std"])


@query("SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events")
def count_weighted_stats(spark, d):
    s = S.count_weighted(S.moments(table(spark, d, "events"), ["user_id"], population=True), [])
    return _rounded(s, ["min", "max", "n"], ["mean", "std"])


@query("""WITH e AS (SELECT min(value) AS mn, max(value) AS mx, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY user_id), g AS (SELECT avg(m) AS gm FROM e)
SELECT min(mn) AS min, max(mx) AS max, round(avg(m), 6) AS mean, round(sqrt(avg(s * s + (m - gm) * (m - gm))), 6) AS std FROM e, g""")
def v2_dataset_stats(spark, d):
    e = S.moments(table(spark, d, "events"), ["user_id"]).withColumn("one", F.lit(1))
    return _rounded(S.unweighted_over_episodes(e, ["one"]), ["min", "max"], ["mean", "std"])


_GROUPS_SQL = "g AS (SELECT event_type, count(*) AS n, min(value) AS mn, max(value) AS mx, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.01) AS q, CASE event_type WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM events GROUP BY event_type)"


def _groups(spark, d):
    e = table(spark, d, "events")
    w = F.when(F.col("event_type") == "click", 2.0).when(F.col("event_type") == "view", 0.5).otherwise(1.0)
    return S.moments(e, ["event_type"], population=True).join(S.linear_quantiles(e, ["event_type"], (0.01,)), "event_type").withColumn("w", w)


@query(f"WITH {_GROUPS_SQL}, t AS (SELECT sum(w * m) / sum(w) AS gm FROM g) SELECT min(mn) AS min, max(mx) AS max, round(sum(w * m) / sum(w), 6) AS mean, round(sqrt(sum(w * (s * s + (m - gm) * (m - gm))) / sum(w)), 6) AS std, round(sum(w * q) / sum(w), 6) AS q01 FROM g, t")
def mixture_stats(spark, d):
    g = _groups(spark, d).withColumn("one", F.lit(1))
    return _rounded(S.mixture(g, ["one"], "w", ["q01"]), ["min", "max"], ["mean", "std", "q01"])


@query(f"WITH {_GROUPS_SQL} SELECT event_type, round(w * (SELECT sum(n) FROM g) / (SELECT sum(n * w) FROM g), 6) AS norm_weight FROM g")
def mixture_weights(spark, d):
    return _rounded(S.normalised_weights(_groups(spark, d), "n", "w"), ["event_type"], ["norm_weight"])


@query(f"WITH {_GROUPS_SQL} SELECT event_type, greatest(1, CAST(floor(n * w) AS BIGINT)) AS effective FROM g")
def effective_lengths(spark, d):
    return _groups(spark, d).select("event_type", S.effective_length(F.col("n"), F.col("w")).alias("effective"))


@query("SELECT event_type, greatest(100, least(CAST(floor(pow(n, 0.75)) AS BIGINT), 10000)) AS size FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def sample_sizes(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", S.sample_size(F.col("n")).alias("size"))


@query("WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, unnest(range(0, n, 7)) AS anchor FROM e")
def anchor_plan(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.explode(S.anchors(F.col("n"), 7)).alias("anchor"))


@query("""WITH e AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), t AS (SELECT i, asinh(x / 1.5) AS y FROM e),
r AS (SELECT i, y, row_number() OVER (PARTITION BY i ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY i) AS n FROM t)
SELECT CAST(i AS BIGINT) AS dim, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(max(CASE WHEN k = CAST(floor(CAST(0.01 AS DOUBLE) * (n - 1)) AS BIGINT) THEN y END), 6) AS q01 FROM r GROUP BY i""")
def transformed_state_stats(spark, d):
    """Statistics of whole vectors after a compression."""
    v = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
    s = S.transformed_states(v, F.col("e"), lambda c: F.transform(c, lambda x: F.asinh(x / 1.5)), quantiles=(0.01,))
    return s.select(F.col("dim").cast("long").alias("dim"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("q01", 6).alias("q01"))


@query("SELECT event_type, greatest(1, CAST(floor(n * least(1.0::DOUBLE, a / t::DOUBLE)) AS BIGINT)) AS capped FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), (SELECT count(*) AS t FROM events), (SELECT min(c) AS a FROM (SELECT user_id % 4 AS node, count(*) * 3 AS c FROM events GROUP BY user_id % 4))")
def capped_lengths(spark, d):
    e = table(spark, d, "events")
    nodes = e.groupBy((F.col("user_id") % 4).alias("node")).agg((F.count("*") * 3).alias("c"))
    return S.capped_lengths(e.groupBy("event_type").agg(F.count("*").alias("n")), "n", nodes, "c").select("event_type", "capped")


@query("SELECT event_type, round(sum(value) / count(*), 6) AS mean, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY event_type")
def synced_sums(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("*"), 6).alias("mean"), F.sum(F.when(F.col("value") > 20, 1).otherwise(0)).alias("high"))


@query("""WITH f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT event_type, round(avg(value), 6) AS init FROM f WHERE r = 1 GROUP BY event_type""")
def init_positions(spark, d):
    return S.first_frame_means(events(spark, d), KEY, ORDER, "value", ["event_type"]).select("event_type", F.round("init", 6).alias("init"))
