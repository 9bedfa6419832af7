"""Batch forms of the serving operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.operators import serving as S
from epiframe.plans.registry import query, table
from epiframe.plans.windows import FRAMES_SQL, STEPS, events, frames


@query("""WITH f AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT f.event_id, f.i // 5 AS request, f.i % 5 AS position, g.value AS served FROM f JOIN f g ON g.user_id = f.user_id AND g.i = least((f.i // 5) * 5 + f.i % 5, f.n - 1)""")
def chunk_cache_serve(spark, d):
    e = frames(spark, d)
    f = e.select("event_id", "user_id", "ts", e.chunk("value", STEPS).alias("c"))
    return S.chunk_cache(f, "user_id", ["ts", "event_id"], "c", 5).select("event_id", "request", "position", "served")


@query(f"WITH {FRAMES_SQL} SELECT user_id, CAST(i + step AS BIGINT) AS step, round(avg(value), 6) AS value, count(*) AS votes FROM c GROUP BY user_id, i + step")
def temporal_ensemble(spark, d):
    e = frames(spark, d)
    p = e.select("user_id", e.frame_index().cast("long").alias("i"), e.chunk("value", STEPS).alias("c"))
    return S.temporal_ensemble(p, "user_id", "i", "c").withColumn("value", F.round("value", 6))


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN value > 20 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS command FROM events""")
def gripper_hold(spark, d):
    f = events(spark, d).withColumns({"c": F.col("value") > 20, "h": F.col("event_type") == "view"})
    return S.held_command(f, "user_id", ["ts", "event_id"], "c", "h").select("event_id", "command")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS recording FROM events")
def recordings(spark, d):
    return S.recordings(events(spark, d).withColumn("r", F.col("event_type") == "error"), "user_id", ["ts", "event_id"], "r").select("event_id", "recording")


@query("SELECT event_id, event_id % 7 AS init, event_id % 3 AS environment FROM events")
def trial_plan(spark, d):
    return S.trial_plan(table(spark, d, "events").select("event_id"), "event_id", 7, 3)


_WAIT = 40_000


@query(f"""WITH RECURSIVE q AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, arrival, i, arrival AS began, 1 AS c, 0 AS batch FROM q WHERE i = 1
  UNION ALL SELECT q.user_id, q.event_id, q.arrival, q.i, CASE WHEN q.arrival >= r.began + {_WAIT} OR r.c = 4 THEN q.arrival ELSE r.began END,
    CASE WHEN q.arrival >= r.began + {_WAIT} OR r.c = 4 THEN 1 ELSE r.c + 1 END, r.batch + CASE WHEN q.arrival >= r.began + {_WAIT} OR r.c = 4 THEN 1 ELSE 0 END
  FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
SELECT user_id, event_id, CAST(arrival AS BIGINT) AS arrival, CAST(batch AS BIGINT) AS batch,
  CAST(CASE WHEN count(*) OVER w = 4 THEN max(arrival) OVER w ELSE began + {_WAIT} END AS BIGINT) AS flushed FROM r WINDOW w AS (PARTITION BY user_id, batch)""")
def micro_batch_replay(spark, d):
    """Requests of a server gathered until there are four, or the wait since the first has passed."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("arrival"))
    return S.micro_batches(e, "user_id", "arrival", "event_id", 4, _WAIT)
