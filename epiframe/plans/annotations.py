"""Queries of text and token annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import text as T
from epiframe.operators import samples as P
from epiframe.plans.numbers import _VEC, _vec
from epiframe.plans.registry import query, table


@query("SELECT c_custkey, split_part(t, '@', 1) AS first_side, CASE WHEN contains(t, '@') THEN split_part(t, '@', 2) ELSE t END AS second_side FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '@' || c_mktsegment END AS t FROM customer)")
def language_sides(spark, d):
    t = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@"), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.language_side(t, False).alias("first_side"), T.language_side(t, True).alias("second_side"))


@query("SELECT c_custkey, trim(c_name) AS task, CASE WHEN c_custkey % 2 = 0 THEN '1. ' || c_mktsegment || chr(10) || '2. done' END AS plan, CASE WHEN c_custkey % 2 = 0 THEN '2. done' END AS step FROM customer")
def plan_marker_split(spark, d):
    plan = F.concat(F.lit("1. "), "c_mktsegment", F.lit("\n2. done"))
    t = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("\n[PLAN]\n"), plan)).otherwise(F.col("c_name"))
    task, p = T.split_plan(t)
    return table(spark, d, "customer").select("c_custkey", task.alias("task"), p.alias("plan"), T.plan_step(p, F.lit(2)).alias("step"))


_CUT = "lpad(CAST(CAST(greatest(0, least(round_even({x} * 1024, 0), 1023)) AS INTEGER) AS VARCHAR), 4, '0')"


@query(f"WITH {_VEC}, b AS (SELECT vec_id, round(abs(e[1]), 3) AS x1, round(abs(e[2]), 3) AS y1, round(abs(e[3]) + 0.5, 3) AS x2, round(abs(e[4]) + 0.5, 3) AS y2 FROM v) SELECT vec_id, 'BBox: cup <loc' || {_CUT.format(x='y1')} || '><loc' || {_CUT.format(x='x1')} || '><loc' || {_CUT.format(x='y2')} || '><loc' || {_CUT.format(x='x2')} || '>' AS text FROM b")
def bbox_loc_text(spark, d):
    at = lambda i, shift: F.round(F.abs(F.element_at("e", i)) + shift, 3)
    payload = F.to_json(F.create_map(F.lit("cup"), F.array(at(1, 0.0), at(2, 0.0), at(3, 0.5), at(4, 0.5))))
    return _vec(spark, d).select("vec_id", T.boxes_text(payload).alias("text"))


@query(f"WITH {_VEC}, n AS (SELECT vec_id, CAST(greatest(0, least(round_even(round(abs(e[1]), 3) * 1024, 0), 1023)) AS DOUBLE) / 1024 AS a, CAST(greatest(0, least(round_even((round(abs(e[3]) + 0.5, 3)) * 1024, 0), 1023)) AS DOUBLE) / 1024 AS b FROM v) SELECT vec_id, least(a, b) AS low, greatest(a, b) AS high FROM n WHERE a <> b")
def loc_parse(spark, d):
    a, b = F.round(F.abs(F.element_at("e", 1)), 3), F.round(F.abs(F.element_at("e", 3)) + 0.5, 3)
    t = F.concat(T.loc(b), T.loc(b), T.loc(a), T.loc(a))
    box = F.element_at(T.parse_boxes(t), 1)
    return _vec(spark, d).select("vec_id", box.alias("b")).where("b is not null").select("vec_id", F.element_at("b", 1).alias("low"), F.element_at("b", 3).alias("high"))


@query("SELECT conv_id, turn, CASE WHEN t IN ('', 'nothing') THEN NULL WHEN t IN ('reset', 'stop') THEN t WHEN starts_with(t, '[low]') THEN '[Low]' || t[6:] ELSE '[Low]: ' || t END AS tagged FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN role WHEN 1 THEN 'stop' WHEN 2 THEN '[low] ' || role ELSE 'nothing' END AS t FROM conversations)")
def instruction_tag(spark, d):
    k = F.col("conv_id") % 4
    t = F.when(k == 0, F.col("role")).when(k == 1, "stop").when(k == 2, F.concat(F.lit("[low] "), "role")).otherwise("nothing")
    return table(spark, d, "conversations").select("conv_id", "turn", T.tag_instruction(t).alias("tagged"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_partkey, 'go ' || p_name AS span FROM part")
def action_span(spark, d):
    t = F.concat(F.lit("think | Action: go "), "p_name", F.lit("|rest"))
    return table(spark, d, "part").select("p_partkey", T.action_span(t).alias("span"))


@query("SELECT event_id, len(list_filter([event_id % 7, event_id % 5, event_id % 3], lambda x: x > 0)) + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events")
def group_serialize(spark, d):
    e = F.col("event_id")
    codes = F.filter(F.array(e % 7, e % 5, e % 3), lambda x: x > 0)
    s = T.serialize_groups([(1000, codes, F.lit(False)), (1001, F.array().cast("array<bigint>"), e % 2 == 0)])
    return table(spark, d, "events").select("event_id", F.size(s).cast("long").alias("n"))


@query("SELECT row_number() OVER (ORDER BY event_type) - 1 + 5000 AS token, event_type FROM (SELECT DISTINCT event_type FROM events)")
def token_registry(spark, d):
    from epiframe.operators.selection import rank_rows

    r = rank_rows(table(spark, d, "events").select("event_type").distinct(), ["event_type"], "r")
    return r.select((F.col("r") + 5000).alias("token"), "event_type")


@query("SELECT coalesce(a.n_name, b.n_name) AS name, a.n_nationkey AS old_id, b.n_nationkey + 100 AS new_id FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 5) b ON a.n_name = b.n_name")
def vocabulary_remap(spark, d):
    from epiframe.operators.lookups import remapped_vocabulary

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return remapped_vocabulary(n.where("id < 15"), n.where("id > 5").select("name", (F.col("id") + 100).alias("id")), "name", "id").select("name", "old_id", "new_id")


@query("SELECT c_custkey, sha256('{\"a\":' || CAST(c_custkey AS VARCHAR) || ',\"b\":\"' || c_mktsegment || '\"}') AS digest FROM customer")
def cache_digest(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.to_json(F.struct(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("b"))), 256).alias("digest"))


_CHOICE = "CASE WHEN u * (a + b + 1) < a THEN 0 WHEN u * (a + b + 1) < a + b THEN 1 ELSE 2 END"


@query(f"SELECT event_id, {_CHOICE} AS choice FROM (SELECT event_id, (event_id * 37 % 101) / 101.0 AS u, CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 0 END AS a, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0 END AS b FROM events)")
def builder_choice(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", T.weighted_choice([e % 2 == 0, e % 3 == 0, F.lit(True)], [2.0, 1.0, 1.0], (e * 37 % 101) / 101.0).alias("choice"))


@query("SELECT major, max(minor) AS minor FROM (SELECT event_id % 3 AS major, event_id % 11 AS minor FROM events) WHERE major = 2 GROUP BY major")
def best_version(spark, d):
    v = table(spark, d, "events").select((F.col("event_id") % 3).alias("major"), (F.col("event_id") % 11).alias("minor")).where("major = 2")
    return v.groupBy("major").agg(F.max_by("minor", F.struct("major", "minor")).alias("minor"))


_CAMERA = "CASE customer.c_custkey % 4 WHEN 0 THEN 'Left-Wrist Cam' WHEN 1 THEN 'head.RGB' WHEN 2 THEN 'side  view' ELSE 'depth' END"


@query(f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'wrist_left' WHEN 1 THEN 'exterior' WHEN 2 THEN 'exterior' END AS slot, trim(regexp_replace(lower({_CAMERA}), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM customer")
def camera_slots(spark, d):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "Left-Wrist Cam").when(k == 1, "head.RGB").when(k == 2, "side  view").otherwise("depth")
    return table(spark, d, "customer").select("c_custkey", P.camera_slot(raw).alias("slot"), P.camera_name(raw).alias("name"))


@query("SELECT c_mktsegment, slot, min(c_name) AS camera FROM (SELECT c_mktsegment, c_name || ' front' AS c_name, 'exterior' AS slot FROM customer) GROUP BY c_mktsegment, slot")
def camera_pick(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", F.concat("c_name", F.lit(" front")).alias("camera"))
    return P.pick_cameras(c, "c_mktsegment", "camera", ["front"]).select("c_mktsegment", "slot", "camera")


@query("SELECT event_id, 'move to <loc' || lpad(CAST(least(CAST(floor((event_id % 97) / 100.0 * 1024) AS INTEGER), 1023) AS VARCHAR), 4, '0') || '><loc0512> now' AS text FROM events")
def coordinate_tokens(spark, d):
    t = F.format_string("move to [%.2f, 0.5] now", (F.col("event_id") % 97) / F.lit(100.0))
    return table(spark, d, "events").select("event_id", T.coordinates_to_loc(t).alias("text"))


@query("SELECT event_id, event_type AS arm, CAST(user_id AS VARCHAR) AS hand FROM events")
def part_tags(spark, d):
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<arm>"), "event_type", F.lit(" <hand> "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("<hand>"), F.col("user_id").cast("string"), F.lit("<arm> "), "event_type"))
    m = table(spark, d, "events").select("event_id", T.split_tags(t, ["<arm>", "<hand>"]).alias("m"))
    return m.select("event_id", F.col("m")["<arm>"].alias("arm"), F.col("m")["<hand>"].alias("hand"))


@query("SELECT user_id, round((SELECT avg(value) FROM events), 6) AS mean FROM (SELECT DISTINCT user_id FROM events)")
def broadcast_stats(spark, d):
    e = table(spark, d, "events")
    return P.with_global_stats(e.select("user_id").distinct(), e.agg(F.round(F.avg("value"), 6).alias("mean")))


@query("SELECT event_id, CAST(i AS BIGINT) AS i, round(value + i * 0.1, 6) AS t FROM events, (SELECT unnest(range(0, 3)) AS i)")
def trajectory_times(spark, d):
    t = table(spark, d, "events").select("event_id", F.posexplode(P.trajectory_times(F.col("value"), 0.1, F.lit(3))).alias("i", "t"))
    return t.select("event_id", F.col("i").cast("long").alias("i"), F.round("t", 6).alias("t"))


@query("SELECT event_id // 64 AS batch, count(*) AS n, CAST(sum(event_id % 3 + 1) AS BIGINT) AS items FROM events GROUP BY event_id // 64")
def collate_batches(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("batch"), F.array_repeat("value", (F.col("event_id") % 3 + 1).cast("int")).alias("v"))
    return P.collate(e, "batch", "v", ["event_id"]).select("batch", F.size("rows").cast("long").alias("n"), F.size(F.flatten("rows")).cast("long").alias("items"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Plan: ' || role ELSE 'Task: ' || text END AS sample FROM conversations")
def built_samples(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("task"), F.when(F.col("conv_id") % 3 == 0, F.col("role")).alias("plan"))
    return P.build_samples(c, {"plan": 1.0}, "conv_id").select("conv_id", "turn", "sample")


_HEAD = "'<chat_user_prefix><image0_image_!><image1_image_!><bos>Embodiment: <embodiment_text_!>; Task: <command_text_!_200>' || {memory} || ' State: <proprio_proprio_!>;<chat_user_suffix><chat_assistant_prefix>Action: <EOV><EOC><action_action>|<eos>'"


@query(f"SELECT conv_id, turn, CASE WHEN m THEN 'memory' ELSE 'base' END AS builder, text AS command, {_HEAD.format(memory="CASE WHEN m THEN ' Memory: <memory_text_!>' ELSE '' END")} AS template, CASE WHEN m THEN role END AS memory_slot FROM (SELECT *, conv_id % 3 = 0 AS m FROM conversations)")
def template_samples(spark, d):
    from epiframe.operators import templates

    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("task"), F.when(F.col("conv_id") % 3 == 0, F.col("role")).alias("memory"))
    out = templates.build(c, {"memory": 1.0, "subtask": 2.0}, "conv_id")
    return out.select("conv_id", "turn", "builder", "command", "template", F.try_element_at("slots", F.lit("memory")).alias("memory_slot"))
