"""Queries of filters, splits, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import arrays as A
from epiframe.operators import selection as S
from epiframe.plans.registry import query, table
from epiframe.plans.windows import FRAMES_SQL, STEPS, events, frames


@query("SELECT event_id, user_id, value FROM events WHERE user_id IN (1, 3, 5)")
def episode_scan(spark, d):
    return table(spark, d, "events").where(F.col("user_id").isin(1, 3, 5)).select("event_id", "user_id", "value")


@query("SELECT event_id, value FROM events WHERE event_id IN (SELECT o_custkey FROM orders)")
def sparse_rows(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"))
    return table(spark, d, "events").join(wanted, "event_id", "left_semi").select("event_id", "value")


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_episodes FROM events")
def row_counts(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_episodes"))


_SPLIT = "WITH e AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id FROM e WHERE r {op} CAST(floor(n * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)"


@query(_SPLIT.format(op="<"))
def train_split(spark, d):
    return S.split_episodes(table(spark, d, "events").select("user_id").distinct(), "user_id", 0.2, True)


@query(_SPLIT.format(op=">="))
def val_split(spark, d):
    return S.split_episodes(table(spark, d, "events").select("user_id").distinct(), "user_id", 0.2, False)


@query("SELECT d.doc_id, n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def success_filter(spark, d):
    return S.successful_only(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def failed_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_anti")


@query("""WITH m AS (SELECT event_id, user_id, value, row_number() OVER w AS i, abs(value - lag(value) OVER w) AS mv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, coalesce(min(i) FILTER (mv > 60), max(i)) AS st FROM m GROUP BY user_id)
SELECT m.event_id, m.value FROM m JOIN s USING (user_id) WHERE m.i >= s.st""")
def first_movement_trim(spark, d):
    return S.first_movement(events(spark, d), "user_id", ["ts", "event_id"], "value", 60.0).select("event_id", "value")


@query("""SELECT d.doc_id, l.quality IS NULL OR lower(trim(CAST(CASE WHEN l.toxic = 1 THEN -1 ELSE l.quality END AS VARCHAR))) IN ('', 'null', 'none', 'nan', '-1') AS missing
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def annotation_missing(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    c = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, F.lit(-1)).otherwise(F.col("quality"))
    return j.select("doc_id", S.is_missing(c).alias("missing"))


_ACTIVE = f"WITH {FRAMES_SQL}, z AS (SELECT event_id, step, value, first_value(value) OVER (PARTITION BY event_id ORDER BY step) AS v0 FROM c), a AS (SELECT event_id, bool_or(abs(value - v0) >= 25) FILTER (step < 4) AS active FROM z GROUP BY event_id) "


@query(_ACTIVE + "SELECT event_id, active FROM a")
def activity_mask(spark, d):
    e = frames(spark, d)
    return e.select("event_id", e.chunk("value", STEPS).alias("c")).select("event_id", S.active(F.col("c"), 25.0, True).alias("active"))


@query(f"""WITH {FRAMES_SQL}, z AS (SELECT event_id, step, value, first_value(value) OVER (PARTITION BY event_id ORDER BY step) AS v0 FROM c)
SELECT event_id, CAST(step AS BIGINT) AS step, CASE WHEN bool_or(step < 4 AND abs(value - v0) >= 25) OVER (PARTITION BY event_id) THEN value ELSE 0 END AS value FROM z""")
def masked_zero(spark, d):
    e = frames(spark, d)
    c = e.select("event_id", e.chunk("value", STEPS).alias("c"))
    return c.select("event_id", F.posexplode(S.zero_where_inactive(F.col("c"), S.active(F.col("c"), 25.0, True))).alias("step", "value")).withColumn("step", F.col("step").cast("long"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%gripper%' THEN 0.01 WHEN regexp_matches(p_name, 'eef|ee_pose') THEN 0.02 WHEN regexp_matches(p_name, 'torso|chassis') THEN 0.03 ELSE 0.04 END::DOUBLE AS threshold
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'left_gripper' WHEN 1 THEN 'right_ee_pose' WHEN 2 THEN 'torso' ELSE 'arm' END AS p_name FROM part)""")
def threshold_resolution(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "left_gripper").when(k == 1, "right_ee_pose").when(k == 2, "torso").otherwise("arm")
    return table(spark, d, "part").select("p_partkey", S.threshold_for(name, {}, 0.01, 0.02, 0.03, 0.04).cast("double").alias("threshold"))


@query("""WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS gap FROM events)
SELECT event_id, round(CAST(gap AS DOUBLE), 6) AS gap FROM g WHERE abs(gap - 3600) > 600""")
def timestamp_gaps(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return S.clock_gaps(e, "user_id", ["ts", "event_id"], "s", 1 / 3600, 600.0).select("event_id", F.round("gap", 6).alias("gap"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def overfit_first_n(spark, d):
    return S.first_n(table(spark, d, "events").select("event_id"), 100, ["event_id"])


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 5")
def first_n_per_group(spark, d):
    return S.first_n(table(spark, d, "events").select("event_type", "event_id"), 5, ["event_id"], ["event_type"])


@query("SELECT user_id FROM (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY user_id) WHERE a >= 2 AND b <= 100000")
def episodes_in_range(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return S.inside_range(e, "a", "b", 2, 100_000).select("user_id")


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT c_custkey AS i, (c_custkey * {s} + 5000019 % n) % n AS j FROM customer, n".replace("{s}", "(SELECT min(k) FROM range(1, 100000) t(k), n WHERE k >= greatest(1, CAST(floor(n * CAST(0.618 AS DOUBLE)) AS BIGINT)) AND gcd(k, n) = 1)"))
def undersample_permutation(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("i"), S.epoch_index(F.col("c_custkey"), c.count(), 5, 4).alias("j"))


@query("WITH i AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, i % 4 AS rank, (i // 4) // 8 AS batch FROM i")
def rank_batches(spark, d):
    return S.rank_batches(table(spark, d, "events").select("event_type", "event_id"), "event_type", ["event_id"], 4, 8).select("event_id", "rank", "batch")


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, i AS rank FROM r WHERE i >= 3 * 64")
def resume_rows(spark, d):
    r = S.rank_rows(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "rank")
    return S.resume_after(r, "rank", 3, 64).select("event_id", "rank")


@query("SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rank FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem)")
def ranked_payload(spark, d):
    """Global ranks of a table of many partitions that keeps its other columns."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").repartition(27)
    return S.rank_rows(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "rank", buckets=24)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 5 = 2")
def strided_shard(spark, d):
    return S.rank_rows(table(spark, d, "events").select("event_id"), ["event_id"]).where(S.strided_shard(F.col("_rank"), 5, 2)).select("event_id")


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
def set_difference(spark, d):
    return S.missing_keys(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k")), ["k"])


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region")
def feature_intersection(spark, d):
    return S.common_keys(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k")), ["k"])


@query("SELECT c_custkey AS id, 'customer' AS part FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("part")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("part")))


@query("""SELECT coalesce(n.k, c.k) AS key, coalesce(n.v, '<MISSING>') AS left_value, coalesce(c.v, '<MISSING>') AS right_value
FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) n FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer) c ON n.k = c.k WHERE coalesce(n.v, '<MISSING>') <> coalesce(c.v, '<MISSING>')""")
def key_diff(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return S.key_diff(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), "k", "v")


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events WHERE value < 5 GROUP BY user_id, event_type")
def invalid_log(spark, d):
    return S.invalid_log(table(spark, d, "events").where("value < 5"), ["user_id", "event_type"], "event_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def ordered_dedupe(spark, d):
    return S.keep_first(table(spark, d, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id")


@query("SELECT vec_id, CAST(sum(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def nan_audit(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.bad_values("embedding").cast("long").alias("bad"))


@query("SELECT event_id, abs(value * 10 - round_even(value * 10, 0)) / 10 <= 0.01 AS whole FROM events")
def offset_multiples(spark, d):
    return table(spark, d, "events").select("event_id", S.offsets_are_frames(F.col("value"), 10.0, 0.01).alias("whole"))


@query("""SELECT vec_id, CAST(CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN label IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_errors FROM embeddings""")
def frame_validation(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 7)).otherwise(F.col("embedding")))
    return v.select("vec_id", F.size(S.frame_errors({"embedding": ("vector", 64), "label": ("scalar", 1)})).cast("long").alias("n_errors"))


@query("SELECT DISTINCT user_id FROM events")
def unique_indices(spark, d):
    return S.unique_sorted(table(spark, d, "events"), "user_id")


@query("""WITH i AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT event_type, n, unnest(range(0, CAST(ceil(n / 32.0) AS BIGINT) * 32)) AS i FROM (SELECT DISTINCT event_type, n FROM i))
SELECT i.event_id, p.i % 4 AS rank, (p.i // 4) // 8 AS batch FROM p JOIN i ON i.event_type = p.event_type AND i.i = p.i % p.n""")
def padded_batches(spark, d):
    return S.rank_batches(table(spark, d, "events").select("event_type", "event_id"), "event_type", ["event_id"], 4, 8, "pad").select("event_id", "rank", "batch")


@query("WITH i AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, i % 4 AS rank, (i // 4) // 8 AS batch FROM i WHERE i < n // 32 * 32")
def full_batches(spark, d):
    return S.rank_batches(table(spark, d, "events").select("event_type", "event_id"), "event_type", ["event_id"], 4, 8, "drop").select("event_id", "rank", "batch")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")
def qualified_rows(spark, d):
    return S.qualified_only(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), "quality").select("doc_id")


@query(f"""WITH {FRAMES_SQL}, z AS (SELECT event_id, step, value, first_value(value) OVER (PARTITION BY event_id ORDER BY step) AS v0 FROM c)
SELECT event_id, bool_or(abs(value - v0) >= 25) FILTER (step < 4) AS d0, bool_or(value >= 80) FILTER (step < 4) AS d1 FROM z GROUP BY event_id""")
def activity_by_dim(spark, d):
    e = frames(spark, d)
    c = e.select("event_id", F.transform(e.chunk("value", STEPS), lambda x: F.array(x, x)).alias("c"))
    m = c.select("event_id", S.active_dims(F.col("c"), [25.0, 80.0], True).alias("r"), S.active_dims(F.col("c"), [25.0, 80.0], False).alias("a"))
    return m.select("event_id", F.get("r", F.lit(0)).alias("d0"), F.get("a", F.lit(1)).alias("d1"))


@query("SELECT vec_id, NOT (bool_or(x >= 0.2)) AS noop FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def noop_parts(spark, d):
    v = table(spark, d, "embeddings").withColumns({"m": F.transform("embedding", lambda x: x >= F.lit(0.2).cast("float")), "p": F.transform("embedding", lambda x: F.lit(False))})
    return v.select("vec_id", S.noop_parts(F.col("m"), F.col("p"), 0, 64).alias("noop"))
