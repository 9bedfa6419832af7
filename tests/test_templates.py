import json

import pytest
from pyspark.sql import functions as F

from epiframe.operators import templates as P

FULL = {
    "task": "fold", "memory": "m0", "memory_update": "m1", "atomic_task": "grasp", "future_task": "lift", "action_hint": "left closes",
    "high_level_instruction": "tidy up", "plan": "0. pick\n1. place it\n2. go", "plan_step": 1,
    "bbox": json.dumps({"cup": [0.25, 0.5, 0.75, 1.0], "bad": []}), "trace_2d": json.dumps({"uv_left": [0.5, 0.25], "visb_left": True, "uv_right": None, "visb_right": False}),
}
SCHEMA = "id long, task string, memory string, memory_update string, atomic_task string, future_task string, action_hint string, high_level_instruction string, plan string, plan_step long, bbox string, trace_2d string"


@pytest.fixture(scope="module")
def frames(spark):
    none = {k: None for k in FULL}
    rows = [FULL, none | {"task": "fold"}, FULL | {"atomic_task": " None ", "bbox": "{}", "trace_2d": "{}", "memory_update": "", "plan_step": 9}]
    return spark.createDataFrame([(i, *(r[c.split()[0]] for c in SCHEMA.split(", ")[1:])) for i, r in enumerate(rows)], SCHEMA)


def one(frames, name, **options):
    return {r.id: r for r in P.build(frames, {name: 1.0}, "id", **options).collect()}


@pytest.mark.parametrize("name", sorted(P.TEMPLATES))
def test_each_template(frames, name):
    got = one(frames, name)
    assert got[0].builder == name and got[0].template == P.TEMPLATES[name].text(2)
    assert got[1].builder == (name if name in ("base", "base_continuous", "task_as_subtask") else "base")
    assert set(got[0].slots) == {"embodiment", *P.TEMPLATES[name].slots}
    text = frames.sparkSession.createDataFrame([(got[0].template, got[0].command, got[0].slots)], "t string, c string, s map<string,string>").select(P.rendered(F.col("t"), F.col("c"), F.col("s"))).first()[0]
    assert "_text" not in text and text.startswith("<chat_user_prefix>" if name != "base_continuous" else "<image0_image_!><image1_image_!><bos>")


def test_slot_texts(frames):
    assert one(frames, "boxes")[0].slots["bbox"] == "BBox: cup <loc0512><loc0256><loc1023><loc0768>"
    assert one(frames, "trace")[0].slots["trace_2d"] == "Trace: Left <loc0512><loc0256>; Right None"
    assert one(frames, "plan_step")[0].slots["plan_step"] == "Step: place it"
    assert one(frames, "plan_step")[2].slots["plan_step"] == ""
    assert one(frames, "memory_update")[0].slots["memory_update"] == "Updated Memory: m1"
    assert one(frames, "memory_update")[2].builder == "base"
    assert one(frames, "subtask_hint")[0].slots["action_hint"] == "ActionHint: left closes"
    assert [one(frames, n)[2].builder for n in ("subtask", "boxes", "trace")] == ["base"] * 3


def test_command_slot(frames):
    assert one(frames, "high_level_subtask")[0].command == "tidy up"
    assert one(frames, "atomic_command", instruction="do it")[0].command == "grasp"
    got = one(frames, "subtask", instruction="do it")
    assert got[0].command == got[1].command == "do it"


def test_serving(frames):
    got = {n: [r.builder for r in P.build(frames, {"subtask": 1.0}, "id", served_by=n, serving=True).orderBy("id").collect()] for n in ("boxes", "boxes_subtask", "memory", "trace")}
    assert got == {"boxes": ["boxes", "base", "base"], "boxes_subtask": ["boxes_subtask"] * 3, "memory": ["memory", "base", "memory"], "trace": ["trace"] * 3}
    assert {r.builder for r in P.build(frames, {"subtask": 1.0}, "id", serving=True).collect()} == {"base"}


def test_weights(spark, frames):
    with pytest.raises(ValueError):
        P.build(frames, {"memory": 0.0}, "id")
    many = spark.range(4000).withColumns({"task": F.lit("t"), "memory": F.lit("m")})
    n = {r.builder: r["count"] for r in P.build(many, {"base": 1.0, "memory": 3.0, "subtask": 9.0}, "id").groupBy("builder").count().collect()}
    assert set(n) == {"base", "memory"} and 0.7 < n["memory"] / 4000 < 0.8
    assert P.build(many.where("id < 0"), {"memory": 1.0}, "id").count() == 0
