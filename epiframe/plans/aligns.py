"""Queries of vector projection and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import align as L
from epiframe.functions import arrays as A
from epiframe.plans.numbers import _VEC, _vec
from epiframe.plans.registry import query, table


def _rows(df, vector, keep="vec_id"):
    return df.select(keep, F.posexplode(vector).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))


_LONG = "SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, p[i] AS x FROM p, (SELECT unnest(range(1, 100)) AS i) WHERE i <= len(p)"


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e[4:9] AS p FROM v) {_LONG}")
def slice_part(spark, d):
    return _rows(_vec(spark, d), A.part("e", 3, 6))


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e[1:3] || e[21:22] AS p FROM v) {_LONG}")
def concat_parts(spark, d):
    return _rows(_vec(spark, d), A.join_parts(A.part("e", 0, 3), A.part("e", 20, 2)))


@query(f"WITH {_VEC}, p AS (SELECT vec_id, [e[6], e[2], e[6]] AS p FROM v) {_LONG}")
def take_positions(spark, d):
    return _rows(_vec(spark, d), A.take("e", [5, 1, 5]))


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e[5:7] || e[1:4] AS p FROM v) {_LONG}")
def reorder_blocks(spark, d):
    return _rows(_vec(spark, d), A.reorder_blocks(F.slice("e", 1, 7), 4, 3))


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e[1:3] || [0.0::DOUBLE, 0.0::DOUBLE] AS p FROM v) {_LONG}")
def pad_merge(spark, d):
    return _rows(_vec(spark, d), A.pad_right(F.slice("e", 1, 3), 5))


_SLOTS = [L.Slot("arm", ("arm", "eef"), 4), L.Slot("gripper", ("gripper",), 2), L.Slot("base", ("base",), 1)]


def _parts():
    even = F.col("vec_id") % 2 == 0
    return {"arm": F.when(even, F.slice("e", 1, 3)), "eef": F.slice("e", 11, 6), "gripper": F.slice("e", 7, 1)}


@query(f"WITH {_VEC}, p AS (SELECT vec_id, (CASE WHEN vec_id % 2 = 0 THEN e[1:3] || [0.0::DOUBLE] ELSE e[11:14] END) || e[7:7] || [0.0::DOUBLE, 0.0::DOUBLE] AS p FROM v) {_LONG}")
def grouped_merge(spark, d):
    return _rows(_vec(spark, d), L.merge(_parts(), _SLOTS))


@query("SELECT vec_id, CAST(i AS BIGINT) AS dim, i < 6 AS x FROM embeddings, (SELECT unnest(range(0, 7)) AS i)")
def grouped_mask(spark, d):
    return _rows(_vec(spark, d), L.merged_mask(_parts(), _SLOTS))


@query("SELECT vec_id, CAST(i AS BIGINT) AS dim, i >= 3 AS x FROM embeddings, (SELECT unnest(range(0, 6)) AS i)")
def dim_pad_mask(spark, d):
    return _rows(_vec(spark, d), L.pad_to(F.slice("e", 1, 3), 6)[1])


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e || [0.0::DOUBLE] AS p FROM v) SELECT vec_id, CAST((i - 1) // 5 AS BIGINT) AS piece, CAST((i - 1) % 5 AS BIGINT) AS dim, p[i] AS x FROM p, (SELECT unnest(range(1, 66)) AS i)")
def fixed_chunks(spark, d):
    c = _vec(spark, d).select("vec_id", F.posexplode(A.fixed_chunks("e", 5)).alias("piece", "p"))
    return c.select("vec_id", F.col("piece").cast("long").alias("piece"), F.posexplode("p").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))


@query(f"WITH {_VEC}, k AS (SELECT vec_id, list_filter(e, lambda x: x > 0) || list_filter(e, lambda x: NOT x > 0) AS p FROM v), p AS (SELECT * FROM k) {_LONG}")
def left_align(spark, d):
    return _rows(_vec(spark, d), A.left_aligned("e", F.transform("e", lambda x: x > 0)))


@query(f"WITH {_VEC}, p AS (SELECT vec_id, e[1:6] || e[61:64] AS p FROM v) {_LONG}")
def keep_suffix(spark, d):
    return _rows(_vec(spark, d), A.keep_suffix(F.slice("e", 1, 60), F.slice("e", 61, 4), 10))


@query("SELECT label, CAST(max(len(embedding)) AS BIGINT) AS widest, CAST(sum(len(embedding)) AS BIGINT) AS total FROM embeddings GROUP BY label")
def shape_sums(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).cast("long").alias("widest"), F.sum(F.size("embedding")).cast("long").alias("total"))


@query(f"WITH {_VEC} SELECT vec_id, coalesce(CAST((SELECT min(i) FROM (SELECT unnest(range(1, 65)) AS i) WHERE abs(e[i] - e[7]) < 1e-6) AS BIGINT), 0) - 1 AS place FROM v")
def approx_membership(spark, d):
    return _vec(spark, d).select("vec_id", A.approx_index(F.col("e"), F.element_at("e", 7)).cast("long").alias("place"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, l_linenumber % 3 = 0 AS idle FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN idle THEN '0.0,0.0,0.0' ELSE q || ',' || (q + 1) || ',0.0' END || ',' || q || ',0.0,0.0' AS second,
  CASE WHEN idle THEN 'false,false,false' ELSE 'true,false,false' END || ',true,false,false' AS operated,
  CASE WHEN idle THEN 'true,true,true' ELSE 'false,false,true' END || ',false,true,true' AS padded, CASE WHEN idle THEN NULL ELSE q || ',' || (q + 1) END AS back FROM x""")
def padding_merger(spark, d):
    """Two steps of an arm that some rows lack (two of three dimensions), a gripper cut from two to one, and a virtual part."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), (F.col("l_linenumber") % 3 == 0).alias("idle"))
    two = lambda *xs: F.array(F.array(*(F.lit(9.0) for _ in xs)), F.array(*xs))
    l = l.withColumns({"arm": F.when(~F.col("idle"), two(F.col("q"), F.col("q") + 1)), "grip": two(F.col("q"), F.lit(5.0))})
    widths = {"arm": 3, "grip": 1, "leg": 2}
    parts = L.aligned({"arm": F.col("arm"), "grip": F.col("grip")}, {"arm": F.array(F.lit(True), F.lit(False))}, widths, F.lit(2))
    whole = L.concatenated(parts, F.lit(2))
    l = l.withColumns({"chunk": whole.chunk, "operated": whole.operated, "padded": whole.padded})
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    back = F.when(~F.col("idle"), shown(F.get(L.separated(F.col("chunk"), widths, {"arm": 2, "grip": 1})["arm"], F.lit(1))))
    return l.select("l_orderkey", "l_linenumber", shown(F.get("chunk", F.lit(1))).alias("second"), shown(F.col("operated")).alias("operated"), shown(F.col("padded")).alias("padded"), back.alias("back"))
