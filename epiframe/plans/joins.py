"""Queries of joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.operators import lookups as L
from epiframe.operators.episodes import episode_table, with_offsets
from epiframe.operators.spread import numbered
from epiframe.plans.registry import query, table
from epiframe.plans.windows import KEY, ORDER, events


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_name FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name FROM part GROUP BY p_partkey) ON l_partkey = p_partkey")
def task_decode(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return L.decode(rows, "l_partkey", table(spark, d, "part"), "p_partkey", "p_name", "p_name")


@query("SELECT event_id, coalesce(n_name, '') AS task FROM events LEFT JOIN nation ON user_id = n_nationkey")
def task_decode_missing(spark, d):
    return L.decode(table(spark, d, "events"), "user_id", table(spark, d, "nation"), "n_nationkey", "n_name", "task", "").select("event_id", "task")


@query("SELECT event_id, n_name AS task FROM events LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) ON user_id = k")
def task_decode_ordinal(spark, d):
    return L.decode_ordinal(table(spark, d, "events"), "user_id", table(spark, d, "nation"), ["n_nationkey"], "n_name", "task").select("event_id", "task")


_EPISODES_SQL = "ep AS (SELECT user_id, CAST(sum(count(*)) OVER (ORDER BY user_id) - count(*) AS BIGINT) AS a, CAST(sum(count(*)) OVER (ORDER BY user_id) AS BIGINT) AS b FROM events GROUP BY user_id)"


@query(f"WITH {_EPISODES_SQL} SELECT event_id, user_id, event_id - a AS local FROM (SELECT event_id FROM events) JOIN ep ON event_id >= a AND event_id < b")
def frame_to_episode_range(spark, d):
    e = table(spark, d, "events")
    return L.in_range(e.select("event_id"), "event_id", episode_table(e, "user_id"), "from_index", "to_index", 64).select("event_id", "user_id", (F.col("event_id") - F.col("from_index")).alias("local"))


@query("""WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k, count(*) AS n FROM events GROUP BY event_type),
b AS (SELECT event_type, CAST(sum(n) OVER (ORDER BY k) - n AS BIGINT) AS a, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS z FROM t)
SELECT event_id AS idx, event_type AS dataset, event_id - a AS local FROM (SELECT event_id FROM events) JOIN b ON event_id >= a AND event_id < z""")
def global_to_local_index(spark, d):
    from epiframe.operators.selection import rank_rows

    e = table(spark, d, "events")
    sizes = rank_rows(e.groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"], "k")
    ranges = with_offsets(sizes, "k", "n")
    return L.in_range(e.select(F.col("event_id").alias("idx")), "idx", ranges, "from_index", "to_index", 256).select("idx", F.col("event_type").alias("dataset"), (F.col("idx") - F.col("from_index")).alias("local"))


def _sides(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.where("event_type = 'click'").select("event_id", "user_id", "us"), e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"))


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), v AS (SELECT event_id AS view_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
m AS (SELECT c.event_id, v.view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.us - v.us), v.view_id) AS r FROM c JOIN v ON c.user_id = v.user_id AND abs(c.us - v.us) <= 21600000000)
SELECT c.event_id, m.view_id FROM c LEFT JOIN m ON m.event_id = c.event_id AND m.r = 1""")
def nearest_within_tol(spark, d):
    left, right = _sides(spark, d)
    return L.nearest_within(left, right, "user_id", "us", "us", 21_600_000_000, "event_id", ["view_id"], ["view_id"]).select("event_id", "view_id")


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), v AS (SELECT event_id AS view_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
m AS (SELECT c.event_id, v.view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.us - v.us), v.us DESC, v.view_id DESC) AS r FROM c JOIN v ON c.user_id = v.user_id)
SELECT c.event_id, m.view_id FROM c LEFT JOIN m ON m.event_id = c.event_id AND m.r = 1""")
def nearest_unbounded(spark, d):
    left, right = _sides(spark, d)
    return L.nearest_latest(left, right, ["user_id"], "us", "view_id", "view_id").select("event_id", "view_id")


@query("""WITH r AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
SELECT d.doc_id, r.source AS alternative FROM documents d LEFT JOIN r ON r.lang = d.lang AND r.r = 1""")
def alt_text_first(spark, d):
    from epiframe.operators.selection import keep_first

    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    first = keep_first(docs.where("lang is not null"), ["lang"], ["doc_id"]).select("lang", F.col("source").alias("alternative"))
    return docs.select("doc_id", "lang").join(first, "lang", "left").select("doc_id", "alternative")


@query("SELECT c.conv_id, c.turn, CASE WHEN o.text IS NOT NULL THEN o.text ELSE c.role END AS note FROM conversations c LEFT JOIN (SELECT conv_id, turn, 'special ' || role AS text FROM conversations WHERE (conv_id + turn) % 5 = 0) o ON c.conv_id = o.conv_id AND c.turn = o.turn")
def keyed_override(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    special = c.where("(conv_id + turn) % 5 = 0").select("conv_id", "turn", F.concat(F.lit("special "), "role").alias("text"))
    return L.override(c, ["conv_id", "turn"], special, "text", F.col("role"), "note").select("conv_id", "turn", "note")


@query("""WITH f AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.event_id, b.event_id AS wanted, b.value FROM f a JOIN f b ON a.user_id = b.user_id AND b.i = least(a.i + 3, a.n - 1)""")
def index_remap(spark, d):
    f = numbered(events(spark, d), KEY, ORDER, "i", "n").select("event_id", "user_id", "value", "i", "n")
    asked = f.select("event_id", "user_id", F.least(F.col("i") + 3, F.col("n") - 1).alias("i"))
    return L.requested_rows(asked, f.select("user_id", "i", F.col("event_id").alias("wanted"), "value"), ["user_id", "i"]).select("event_id", "wanted", "value")


@query("WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type) SELECT event_id, round((value - m) / s, 6) AS z FROM events JOIN s USING (event_type)")
def keyed_stats_lookup(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    j = L.require(e.join(s, "event_type", "left"), "m", "no statistics for this group")
    return j.select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"))
