"""Window queries over ``events``: an episode is a user, frames are ordered by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import arrays as A
from epiframe.operators.episodes import Episodes, episode_table, explode_steps, runs, task_masked_chunk
from epiframe.operators.spread import numbered
from epiframe.plans.registry import query, table

STEPS = 8


KEY, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def frames(spark, d, back: int = 0, ahead: int = STEPS - 1) -> Episodes:
    """Frames whose windows reach ``back`` and ``ahead`` of them, cut into blocks where there are many."""
    return Episodes.spread(events(spark, d), KEY, ORDER, back, ahead)


#: Frames with their place, their episode's length and the next values.
FRAMES_SQL = """f AS (SELECT event_id, user_id, event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
steps AS (SELECT unnest(range(0, 8)) AS step),
c AS (SELECT f.event_id, f.user_id, f.i, f.n, s.step, g.value, g.event_type AS task, f.i + s.step >= f.n AS pad
  FROM f CROSS JOIN steps s JOIN f g ON g.user_id = f.user_id AND g.i = least(f.i + s.step, f.n - 1))"""


@query(f"WITH {FRAMES_SQL} SELECT event_id, CAST(step AS BIGINT) AS step, value FROM c")
def chunk_long(spark, d):
    e = frames(spark, d)
    return explode_steps(e.select("event_id", e.chunk("value", STEPS).alias("chunk")), "chunk", keep=["event_id"]).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {FRAMES_SQL} SELECT event_id, CAST(step AS BIGINT) AS step, pad FROM c")
def chunk_pad_mask(spark, d):
    e = frames(spark, d)
    return e.select("event_id", e.chunk_pad(STEPS).alias("m")).select("event_id", F.posexplode("m").alias("step", "pad")).withColumn("step", F.col("step").cast("long"))


@query("""WITH f AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT f.event_id, a.value AS h0, b.value AS h1, c.value AS h2, f.value AS h3 FROM f
JOIN f a ON a.user_id = f.user_id AND a.i = greatest(f.i - 9, 0) JOIN f b ON b.user_id = f.user_id AND b.i = greatest(f.i - 6, 0)
JOIN f c ON c.user_id = f.user_id AND c.i = greatest(f.i - 3, 0)""")
def history_strided(spark, d):
    e = frames(spark, d, 9, 0)
    h = e.select("event_id", e.history("value", 4, 3).alias("h"))
    return h.select("event_id", *(F.element_at("h", k + 1).alias(f"h{k}") for k in range(4)))


@query("SELECT event_id, coalesce(lead(value, 1) OVER w, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shifted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def shift_next_clamped(spark, d):
    e = frames(spark, d, 0, 1)
    return e.select("event_id", e.shift("value", 1).alias("shifted"))


@query("SELECT event_id, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS shifted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def shift_prev_clamped(spark, d):
    e = frames(spark, d, 2, 0)
    return e.select("event_id", e.shift("value", -2).alias("shifted"))


@query("""WITH f AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT f.event_id, a.value AS m4, b.value AS p2, c.value AS p5 FROM f
JOIN f a ON a.user_id = f.user_id AND a.i = greatest(f.i - 4, 0) JOIN f b ON b.user_id = f.user_id AND b.i = least(f.i + 2, f.n - 1)
JOIN f c ON c.user_id = f.user_id AND c.i = least(f.i + 5, f.n - 1)""")
def multi_offset(spark, d):
    e = frames(spark, d, 4, 5)
    h = e.select("event_id", e.at_offsets("value", [-4, 2, 5]).alias("h"))
    return h.select("event_id", F.element_at("h", 1).alias("m4"), F.element_at("h", 2).alias("p2"), F.element_at("h", 3).alias("p5"))


@query("SELECT user_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS length FROM events GROUP BY user_id")
def episode_bounds(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first_us"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"), F.count("*").alias("length"))


@query("""WITH l AS (SELECT user_id, count(*) AS length FROM events GROUP BY user_id)
SELECT user_id, length, CAST(sum(length) OVER (ORDER BY user_id) - length AS BIGINT) AS from_index, CAST(sum(length) OVER (ORDER BY user_id) AS BIGINT) AS to_index FROM l""")
def episode_offsets(spark, d):
    return episode_table(table(spark, d, "events"), "user_id").select("user_id", "length", "from_index", "to_index")


@query(f"""WITH {FRAMES_SQL}, z AS (SELECT *, first_value(task) OVER (PARTITION BY event_id ORDER BY step) AS t0 FROM c),
l AS (SELECT event_id, arg_max(value, step) AS held FROM z WHERE task = t0 GROUP BY event_id)
SELECT z.event_id, CAST(step AS BIGINT) AS step, CASE WHEN task = t0 THEN value ELSE held END AS value, task <> t0 AS padded FROM z JOIN l USING (event_id)""")
def task_change_mask(spark, d):
    e = frames(spark, d)
    c = e.select("event_id", e.chunk("value", STEPS).alias("c"), e.chunk("event_type", STEPS).alias("t"))
    value, padded = task_masked_chunk("c", "t")
    pairs = F.arrays_zip(value.alias("value"), padded.alias("padded"))
    return c.select("event_id", F.posexplode(pairs).alias("step", "p")).select("event_id", F.col("step").cast("long").alias("step"), F.col("p.value").alias("value"), F.col("p.padded").alias("padded"))


@query("""WITH f AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT f.event_id, g.event_type AS future FROM f JOIN f g ON g.user_id = f.user_id AND g.i = least(f.i + 16, f.n - 1)""")
def future_label(spark, d):
    e = frames(spark, d, 0, 16)
    return e.select("event_id", e.shift("event_type", 16).alias("future"))


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT event_id, step, value, coalesce(lag(value) OVER (PARTITION BY event_id ORDER BY step), 10.0) AS before FROM c)
SELECT event_id, CAST(step AS BIGINT) AS step, round(value - before, 6) AS delta FROM v""")
def delta_chunk(spark, d):
    e = frames(spark, d)
    c = e.select("event_id", e.chunk("value", STEPS).alias("c")).select("event_id", A.chunk_delta("c", F.lit(10.0)).alias("x"))
    return explode_steps(c, "x", value="delta", keep=["event_id"]).select("event_id", F.col("step").cast("long").alias("step"), F.round("delta", 6).alias("delta"))


@query(f"WITH {FRAMES_SQL} SELECT event_id, CAST(step AS BIGINT) AS step, round(value, 6) AS value FROM c")
def delta_cumsum_inverse(spark, d):
    e = frames(spark, d)
    c = e.select("event_id", e.chunk("value", STEPS).alias("c"))
    x = c.select("event_id", A.chunk_undelta(A.chunk_delta("c", F.lit(10.0)), F.lit(10.0)).alias("x"))
    return explode_steps(x, "x", keep=["event_id"]).select("event_id", F.col("step").cast("long").alias("step"), F.round("value", 6).alias("value"))


@query("""WITH b AS (SELECT event_id, user_id, ts, value > 20 AS bit FROM events),
g AS (SELECT *, CASE WHEN bit <> lag(bit) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS ch FROM b),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
l AS (SELECT user_id, run, any_value(bit) AS bit, count(*) AS n FROM r GROUP BY user_id, run), m AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS top FROM l)
SELECT user_id, CAST(run AS BIGINT) AS run, bit, n, NOT (run > 0 AND run < top AND n <= 2) AS valid FROM m""")
def run_validity(spark, d):
    bits = runs(events(spark, d).withColumn("bit", F.col("value") > 20), KEY, ORDER, "bit")
    found = bits.groupBy("user_id", "run").agg(F.first("bit").alias("bit"), F.count("*").alias("n"))
    top = found.groupBy("user_id").agg(F.max("run").alias("top"))
    inner = (F.col("run") > 0) & (F.col("run") < F.col("top")) & (F.col("n") <= 2)
    return found.join(top, "user_id").select("user_id", F.col("run").cast("long").alias("run"), "bit", "n", (~inner).alias("valid"))


@query("SELECT event_id, lag(value, 1) OVER w AS back1, lag(value, 3) OVER w AS back3, lead(value, 1) OVER w AS ahead1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def look_around(spark, d):
    e = frames(spark, d, 3, 1)
    return e.select("event_id", F.lag("value", 1).over(e.by).alias("back1"), F.lag("value", 3).over(e.by).alias("back3"), F.lead("value", 1).over(e.by).alias("ahead1"))


@query("SELECT event_id, CAST(round_even(CAST(value AS DOUBLE) * 2.5, 0) AS BIGINT) AS frames FROM events")
def seconds_offsets(spark, d):
    from epiframe.operators.episodes import seconds_to_frames

    return table(spark, d, "events").select("event_id", seconds_to_frames(F.col("value"), 2.5).alias("frames"))


@query("""WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, i AS frame_index, round(i / 30.0, 6) AS timestamp FROM f""")
def frame_clock(spark, d):
    return numbered(events(spark, d), KEY, ORDER).select("event_id", F.col("frame_index").cast("long").alias("frame_index"), F.round(F.col("frame_index") / F.lit(30.0), 6).alias("timestamp"))
