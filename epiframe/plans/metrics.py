"""Queries of metrics: the first half of an embedding is the truth, the second the guess."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.operators import metrics as M
from epiframe.plans.numbers import _VEC, _vec
from epiframe.plans.registry import query, table

PARTS = [("arm", 0, 6), ("gripper", 6, 7), ("base", 7, 10)]
_LONG = f"{_VEC}, l AS (SELECT vec_id, label, CAST(i AS BIGINT) AS dim, e[i + 1] AS t, e[i + 33] AS g, (vec_id + i) % 3 <> 0 AS m FROM v JOIN (SELECT vec_id AS vid, label FROM embeddings) ON vec_id = vid, (SELECT unnest(range(0, 32)) AS i))"
_PART = "CASE WHEN dim < 6 THEN 'arm' WHEN dim < 7 THEN 'gripper' WHEN dim < 10 THEN 'base' END"


def _errors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumns({"t": F.slice("e", 1, 32), "g": F.slice("e", 33, 32), "m": F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.col("vec_id") + i) % 3 != 0)})
    return M.long_errors(v, "t", "g", "m", ["vec_id", "label"])


@query(f"WITH {_LONG} SELECT round(sum(CASE WHEN m AND abs(t - g) < 1 / 256.0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN m THEN 1 ELSE 0 END), 1), 6) AS accuracy, round(sum(CASE WHEN m THEN abs(t - g) ELSE 0 END) / greatest(sum(CASE WHEN m THEN 1 ELSE 0 END), 1), 6) AS l1 FROM l")
def threshold_acc(spark, d):
    return M.threshold_accuracy(_errors(spark, d)).select(F.round("accuracy", 6).alias("accuracy"), F.round("l1", 6).alias("l1"))


@query(f"WITH {_LONG} SELECT label, round(sum(CASE WHEN m AND abs(t - g) < 1 / 256.0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN m THEN 1 ELSE 0 END), 1), 6) AS accuracy, round(sum(CASE WHEN m THEN abs(t - g) ELSE 0 END) / greatest(sum(CASE WHEN m THEN 1 ELSE 0 END), 1), 6) AS l1 FROM l GROUP BY label")
def per_group_metrics(spark, d):
    return M.threshold_accuracy(_errors(spark, d), ["label"]).select("label", F.round("accuracy", 6).alias("accuracy"), F.round("l1", 6).alias("l1"))


@query(f"WITH {_LONG} SELECT {_PART} AS part, round(avg(abs(t - g)), 6) AS l1 FROM l WHERE m AND dim < 10 GROUP BY part")
def per_part_l1(spark, d):
    return M.part_l1(_errors(spark, d), PARTS).select("part", F.round("l1", 6).alias("l1"))


@query(f"WITH {_LONG} SELECT {_PART} AS part, round(avg(CASE WHEN (t > 0.05) = (g > 0.05) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l WHERE m AND dim < 10 GROUP BY part")
def per_part_binary(spark, d):
    return M.binary_accuracy(_errors(spark, d), PARTS, 0.05).select("part", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_LONG}, s AS (SELECT vec_id, avg(abs(t - g)) AS l1 FROM l WHERE m GROUP BY vec_id) SELECT round(coalesce(avg(l1), -1), 6) AS l1 FROM s")
def macro_l1(spark, d):
    return M.macro_l1(_errors(spark, d), ["vec_id"]).select(F.round("l1", 6).alias("l1"))


@query(f"WITH {_VEC}, l AS (SELECT floor(e[i] * 20) AS t, CASE WHEN i <= 8 THEN floor(e[i + 20] * 20) ELSE 0 END AS g FROM v, (SELECT unnest(range(1, 11)) AS i)) SELECT round(sum(CASE WHEN t = g THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM l")
def token_accuracy(spark, d):
    tok = lambda a, n: F.transform(F.slice("e", a, n), lambda x: F.floor(x * 20))
    return M.token_accuracy(_vec(spark, d).select(tok(1, 10).alias("t"), tok(21, 8).alias("g")), "t", "g").select(F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT source AS task, CAST(sum(quality) AS BIGINT) AS successes, count(*) AS trials, round(sum(quality) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source
UNION ALL SELECT '__overall__', CAST(sum(quality) AS BIGINT), count(*), round(sum(quality) / count(*), 6) FROM documents JOIN labels USING (doc_id)""")
def success_rate_rollup(spark, d):
    j = table(spark, d, "documents").select("doc_id", F.col("source").alias("task")).join(table(spark, d, "labels"), "doc_id")
    return M.success_rates(j, "task", "quality").withColumn("rate", F.round("rate", 6))


@query("""SELECT k AS name, round(CASE WHEN k LIKE '%sample_count' THEN sum(value) ELSE avg(value) END, 6) AS value FROM (SELECT CASE WHEN event_id % 2 = 0 THEN event_type || '/sample_count' ELSE event_type || '/l1' END AS k, value FROM events) GROUP BY k""")
def payload_merge(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "/sample_count").otherwise("/l1")).alias("name"), "value")
    return M.merge_payload(e, "name", "value").withColumn("value", F.round("value", 6))
