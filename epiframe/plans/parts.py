"""Queries of parts, transforms and annotation texts over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from epiframe.functions import align, arrays, text, tokens, transforms
from epiframe.operators import metrics, selection, serving, statistics
from epiframe.plans.numbers import _VEC, _vec
from epiframe.plans.registry import query, table
from epiframe.plans.windows import FRAMES_SQL, STEPS, frames


@query(f"WITH {_VEC} SELECT vec_id, round(e[6] + 10 * e[1], 6) AS x, round(e[5] - e[64], 6) AS y FROM v")
def parts_split_and_joined(spark, d):
    """The whole vector split into three parts that are put together in another order."""
    a, b, c = arrays.split_parts(F.col("e"), [5, 1, 58])
    j = _vec(spark, d).withColumn("j", arrays.join_parts(b, c, a))
    return j.select("vec_id", F.round(F.get("j", F.lit(0)) + 10 * F.get("j", F.lit(59)), 6).alias("x"), F.round(F.get("j", F.lit(63)) - F.get("j", F.lit(58)), 6).alias("y"))


_CHUNK_OF_TWO = f"WITH {FRAMES_SQL} SELECT c.event_id, CAST(c.step AS BIGINT) AS step, round({{x}}, 6) AS x, round(c.value, 6) AS y FROM c JOIN f ON f.event_id = c.event_id"


def _two(spark, d):
    """Chunks of vectors (value, value), with the frame's own value."""
    e = frames(spark, d)
    return e.select("event_id", "value", F.transform(e.chunk("value", STEPS), lambda x: F.array(x, x)).alias("c"))


def _steps(df, c):
    rows = df.select("event_id", F.posexplode(c).alias("step", "r"))
    return rows.select("event_id", F.col("step").cast("long").alias("step"), F.round(F.get("r", F.lit(0)), 6).alias("x"), F.round(F.get("r", F.lit(1)), 6).alias("y"))


@query(_CHUNK_OF_TWO.format(x="c.value - f.value"))
def partial_relative(spark, d):
    return _steps(_two(spark, d), transforms.relative(F.col("c"), F.array("value", "value"), dims=[0]))


@query(_CHUNK_OF_TWO.format(x="c.value"))
def composite_round_trip(spark, d):
    """Relative joints, then a scaled and shifted unit, then parts merged into one: forward and back."""
    both = transforms.Composite((
        transforms.RelativeJoint(("arm",), {"arm": F.array("value", "value")}),
        transforms.EachPart(("arm",), lambda c: F.transform(c, lambda r: F.transform(r, lambda x: transforms.affine_unit(x, -1.0, 2.0, 0.5))), lambda c: F.transform(c, lambda r: F.transform(r, lambda x: transforms.affine_unit_inverse(x, -1.0, 2.0, 0.5)))),
    ))
    return _steps(_two(spark, d), both.backward(both.forward({"arm": F.col("c")}))["arm"])


@query(f"WITH {FRAMES_SQL}, v AS (SELECT c.event_id, c.step, c.value, coalesce(lag(c.value) OVER (PARTITION BY c.event_id ORDER BY c.step), f.value) AS before FROM c JOIN f ON f.event_id = c.event_id) SELECT event_id, CAST(step AS BIGINT) AS step, round((value - before) / 0.2::DOUBLE, 6) AS velocity FROM v")
def chunk_velocity(spark, d):
    e = frames(spark, d)
    c = e.select("event_id", "value", e.chunk("value", STEPS).alias("c"))
    return c.select("event_id", F.posexplode(transforms.velocity(F.col("c"), F.col("value"))).alias("step", "v")).select("event_id", F.col("step").cast("long").alias("step"), F.round("v", 6).alias("velocity"))


@query("SELECT event_id FROM events WHERE abs(value / 10 - round_even(value / 10 * 5, 0) / 5.0::DOUBLE) <= 0.08::DOUBLE")
def observation_in_time(spark, d):
    """Observations within the tolerance of a frame of five a second."""
    seconds = F.col("value") / 10
    return table(spark, d, "events").where(F.abs(seconds - F.bround(seconds * 5) / 5) <= transforms.observation_tolerance(5.0)).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS arm, 0.0::DOUBLE AS leg, event_id % 3 = 0 AS here FROM events")
def absent_parts_filled(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("arm"), F.when(F.col("event_id") % 3 == 0, F.array("value"))).alias("p"))
    filled = align.fill_absent(F.col("p"), [("arm", 1), ("leg", 2)])
    return e.withColumn("f", filled).select("event_id", F.get(F.col("f")["arm"], F.lit(0)).alias("arm"), F.get(F.col("f")["leg"], F.lit(1)).alias("leg"), (F.size(align.drop_absent(F.col("p"))) > 0).alias("here"))


@query("SELECT conv_id, turn, '[High]: ' || coalesce(role, '') || ', [Low]: ' || coalesce(text, '') AS whole, '[High]: ' || coalesce(role, '') AS high FROM conversations")
def instruction_levels(spark, d):
    """With no low part dropped, and with all."""
    c = table(spark, d, "conversations")
    parts = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return c.select("conv_id", "turn", text.high_low(*parts, 0.0, F.col("conv_id")).alias("whole"), text.high_low(*parts, 1.0, F.col("conv_id")).alias("high"))


_LOC = "'<loc' || lpad(CAST(CAST(greatest(0, least(round_even({x} * 1024, 0), 1023)) AS INTEGER) AS VARCHAR), 4, '0') || '>'"
_UV = f"WITH {_VEC}, u AS (SELECT vec_id, round(abs(e[1]), 3) AS u, round(abs(e[2]), 3) AS v, vec_id % 3 AS k FROM v)"


@query(f"{_UV} SELECT vec_id, CASE k WHEN 0 THEN 'Trace: Left ' || {_LOC.format(x='u')} || {_LOC.format(x='v')} || '; Right None' WHEN 1 THEN 'Trace: Left None; Right ' || {_LOC.format(x='v')} || {_LOC.format(x='u')} END AS trace FROM u")
def trace_texts(spark, d):
    u, v = (F.round(F.abs(F.element_at("e", i)), 3).cast("string") for i in (1, 2))
    k = F.col("vec_id") % 3
    payload = F.when(k == 0, F.concat(F.lit('{"uv_left":['), u, F.lit(","), v, F.lit('],"visb_left":true,"uv_right":null,"visb_right":false}'))).when(
        k == 1, F.concat(F.lit('{"uv_left":['), u, F.lit(","), v, F.lit('],"visb_left":false,"uv_right":['), v, F.lit(","), u, F.lit('],"visb_right":true}'))
    )
    return _vec(spark, d).select("vec_id", text.trace_text(payload).alias("trace"))


@query(f"{_UV} SELECT vec_id, CASE k WHEN 2 THEN 'cup: Not visible' ELSE 'cup: ' || {_LOC.format(x='u')} || {_LOC.format(x='v')} END AS affordance FROM u")
def affordance_texts(spark, d):
    u, v = (F.round(F.abs(F.element_at("e", i)), 3) for i in (1, 2))
    points = F.when(F.col("vec_id") % 3 == 2, F.array(F.lit(-1.0), F.lit(-1.0))).otherwise(F.array(u, v))
    return _vec(spark, d).select("vec_id", text.points_text(F.lit("cup"), points).alias("affordance"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace('<loc0001>' || coalesce(text, '') || ' |<EOC> end', '<loc[0-9]{4}>|<[A-Z]{3}>|[|]', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS shown FROM conversations")
def shown_reasoning(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.clean_display(F.concat(F.lit("<loc0001>"), F.coalesce("text", F.lit("")), F.lit(" |<EOC> end"))).alias("shown"))


@query("SELECT conv_id, turn, replace(replace('<bos>' || coalesce(role, '') || '<eos>', '<bos>', '<s>'), '<eos>', '</s>') AS resolved FROM conversations")
def resolved_tokens(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.resolve_tokens(F.concat(F.lit("<bos>"), F.coalesce("role", F.lit("")), F.lit("<eos>")), {"<bos>": "<s>", "<eos>": "</s>"}).alias("resolved"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(CAST(value AS DOUBLE), 2) END AS score FROM events")
def last_score(spark, d):
    """The last line of a log that is a number."""
    number = F.format_string("%.2f", "value")
    log = F.when(F.col("event_id") % 5 == 0, F.lit("no score\nat all")).otherwise(F.concat(F.lit("12\nscore\n"), number, F.lit(" \ndone: 1 of 2")))
    return table(spark, d, "events").select("event_id", F.round(text.last_number(log), 2).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 40 || ',' || l_suppkey % 40 AS codes FROM lineitem")
def markers_stripped(spark, d):
    groups = tokens.marked_groups(["a"], ["r"], 1, 1, 1, 40)
    l = table(spark, d, "lineitem")
    marked = tokens.serialize_marked(groups, [F.array(F.col("l_partkey") % 40), F.array(F.col("l_suppkey") % 40)])
    return l.select("l_orderkey", "l_linenumber", F.array_join(tokens.without_markers(marked, groups), ",").alias("codes"))


@query("""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '[A-Za-z]') AND len(w) >= 3 AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) = 0 AS valid FROM w""")
def reasoning_valid(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.valid_reasoning(F.coalesce("text", F.lit(""))).alias("valid"))


@query("SELECT user_id AS step, event_type AS field, round(avg(value), 6) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id, event_type")
def micro_batch_means(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("step"), F.col("event_type").alias("field"), F.col("value").cast("double").alias("value"))
    return metrics.accumulated_means(rows, "step", "field", "value", ["view", "click", "never"]).withColumn("value", F.round("value", 6))


@query("SELECT event_type, quantile_disc(value, 0.25) AS q25, quantile_disc(value, 0.9) AS q9 FROM events GROUP BY event_type")
def sketched_quantiles(spark, d):
    """Sketches that are more accurate than the groups are large give the values themselves."""
    n = 1_000_000
    return statistics.approximate_quantiles(table(spark, d, "events"), ["event_type"], [0.25, 0.9], accuracy=n)


@query("""WITH f AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT f.event_id, f.i // 3 AS request, g.value AS served FROM f JOIN f g ON g.user_id = f.user_id AND g.i = f.i""")
def replanned_queue(spark, d):
    """Asked again after three steps of eight, what is served is what the newest chunk has for the step."""
    e = frames(spark, d)
    f = e.select("event_id", "user_id", "ts", e.chunk("value", STEPS).alias("c"))
    return serving.replanned(f, "user_id", ["ts", "event_id"], "c", STEPS, 3).select("event_id", "request", "served")


@query("SELECT event_id, event_id % 7 AS place, CAST(event_id AS VARCHAR) AS a, CAST(user_id AS VARCHAR) AS b FROM events")
def parsed_pairs(spark, d):
    """``key=value`` texts, and places of an oversampled set."""
    e = table(spark, d, "events")
    pairs = text.key_values(F.concat(F.lit("a="), F.col("event_id").cast("string"), F.lit(",b="), F.col("user_id").cast("string")))
    return e.select("event_id", selection.oversample_index(F.col("event_id"), 7).alias("place"), pairs["a"].alias("a"), pairs["b"].alias("b"))


@query(f"WITH {FRAMES_SQL}, m AS (SELECT event_id, step, value, pad FROM c) SELECT event_id, CAST(step AS BIGINT) AS step, TRUE AS active, round(sqrt(value * value + {math.pi} * 0), 6) AS x FROM m")
def everything_active(spark, d):
    """A mask that keeps every step of a chunk."""
    e = frames(spark, d)
    c = e.select("event_id", e.chunk("value", STEPS).alias("c"))
    z = F.arrays_zip(selection.all_active(STEPS).alias("m"), F.col("c").alias("v"))
    return c.select("event_id", F.posexplode(z).alias("step", "z")).select("event_id", F.col("step").cast("long").alias("step"), F.col("z.m").alias("active"), F.round(F.abs("z.v"), 6).alias("x"))
