"""Sample templates: which annotations a template needs, its text, what fills its slots, and a weighted choice among them.

A template is text with slots in angle brackets; the slots' values travel beside it in a map, so that a tokenizer can
tell what is shown from what is trained.  Everything is a column expression, whatever annotations a frame has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiframe.functions import text as T
from epiframe.operators.selection import hashed_uniform, is_missing

#: Template texts; {images} stands for the image slots.
HEAD = "<chat_user_prefix>{images}<bos>Embodiment: <embodiment_text_!>; Task: <command_text_!_200> State: <proprio_proprio_!>;<chat_user_suffix><chat_assistant_prefix>"
MEMORY_HEAD = "<chat_user_prefix>{images}<bos>Embodiment: <embodiment_text_!>; Task: <command_text_!_200> Memory: <memory_text_!> State: <proprio_proprio_!>;<chat_user_suffix><chat_assistant_prefix>"
PLAN_HEAD = "<chat_user_prefix>{images}<bos>Embodiment: <embodiment_text_!>; Task: <command_text_!_200> Plan: <plan_text_!> State: <proprio_proprio_!>;<chat_user_suffix><chat_assistant_prefix>"
BARE_HEAD = "{images}<bos>Embodiment: <embodiment_text_!>; Task: <command_text_!_200> State: <proprio_proprio_!>;\n"
ACTION = "Action: <EOV><EOC><action_action>|<eos>"
BARE_ACTION = "Action: <EOV><EOC><eos>"
SUBTASK = "<prompt_text_!>\n<EOC><atomic_task_text>|Action: <EOV><action_action>|<eos>"
SUBTASK_BARE = "<prompt_text_!>\n<EOC><atomic_task_text>|Action: <EOV><eos>"
BOXES = "<prompt_text_!>\n<EOC><bbox_text>|Action: <EOV><action_action>|<eos>"
BOXES_SUBTASK = "<prompt_text_!>\n<EOC><bbox_text>|<atomic_task_text>|Action: <EOV><action_action>|<eos>"
TRACE = "<prompt_text_!>\n<EOC><trace_2d_text>|Action: <EOV><action_action>|<eos>"
SUBTASK_HINT = "<prompt_text_!>\n<EOC><atomic_task_text>|<action_hint_text>|Action: <EOV><action_action>|<eos>"
MEMORY_UPDATE = "<cotprefix_text_!><EOC><memory_update_text>|\nAction: <EOV><action_action>|<eos>"
MEMORY_SUBTASK = "<cotprefix_text_!><EOC><atomic_task_text>|<memory_update_text>|\nAction: <EOV><action_action>|<eos>"
PLAN_STEP = "<cotprefix_text_!><EOC><plan_step_text>|\nAction: <EOV><action_action>|<eos>"

Slot = Callable[[], Column]


def _said(prefix: str, name: str) -> Slot:
    return lambda: F.concat(F.lit(prefix), F.coalesce(F.col(name), F.lit("")))


def _fixed(value: str) -> Slot:
    return lambda: F.lit(value)


def _update() -> Column:
    return F.when(F.coalesce(F.col("memory_update"), F.lit("")) == "", "").otherwise(F.concat(F.lit("Updated Memory: "), "memory_update"))


def _step() -> Column:
    """``Step: `` and the plan's line of this number without the number; empty if there is none."""
    number = F.col("plan_step").cast("string")
    line = T.plan_step(F.col("plan"), F.col("plan_step"))
    said = F.trim(F.substring(line, F.length(number) + 2, F.length(line)))
    return F.when(F.coalesce(said, F.lit("")) == "", "").otherwise(F.concat(F.lit("Step: "), said))


def has_boxes() -> Column:
    """Whether ``bbox`` is a JSON object with an entry."""
    return F.coalesce(F.size(F.map_keys(F.from_json("bbox", "map<string,string>"))) > 0, F.lit(False))


def sees_arm() -> Column:
    """Whether ``trace_2d`` marks an arm as visible."""
    t = F.from_json("trace_2d", T.TRACE)
    return F.coalesce(t["visb_left"], F.lit(False)) | F.coalesce(t["visb_right"], F.lit(False))


@dataclass(frozen=True)
class Template:
    """``needs`` are the annotations that training needs, ``needs_served`` those that serving does; ``also`` is a further condition of training, and of serving where its column is needed there."""

    head: str
    body: str
    needs: tuple[str, ...] = ()
    needs_served: tuple[str, ...] = ()
    slots: Mapping[str, Slot] = field(default_factory=dict)
    command: str | None = None
    also: Callable[[], Column] | None = None
    also_served: bool = False

    def text(self, images: int) -> str:
        return self.head.replace("{images}", "".join(f"<image{i}_image_!>" for i in range(images))) + self.body

    def applies(self, columns: list[str], serving: bool = False) -> Column:
        needs = self.needs_served if serving else self.needs
        if any(n not in columns for n in needs):
            return F.lit(False)
        out = F.lit(True)
        for n in needs:
            out = out & ~is_missing(F.col(n))
        return out & self.also() if self.also is not None and (self.also_served or not serving) else out


_SUBTASK = _said("Subtask: ", "atomic_task")
_BOX_TEXT: Slot = lambda: F.coalesce(T.boxes_text(F.col("bbox")), F.lit(""))
_TRACE_TEXT: Slot = lambda: F.coalesce(T.trace_text(F.col("trace_2d")), F.lit("Trace: Left None; Right None"))

TEMPLATES: dict[str, Template] = {
    "base": Template(HEAD, ACTION),
    "base_continuous": Template(BARE_HEAD, BARE_ACTION),
    "memory": Template(MEMORY_HEAD, ACTION, ("memory",), ("memory",), {"memory": _said("", "memory")}),
    "subtask": Template(HEAD, SUBTASK, ("atomic_task",), (), {"prompt": _fixed("predict subtask"), "atomic_task": _SUBTASK}),
    "task_as_subtask": Template(HEAD, SUBTASK, ("task",), (), {"prompt": _fixed("predict subtask"), "atomic_task": _said("Subtask: ", "task")}),
    "subtask_continuous": Template(HEAD, SUBTASK_BARE, ("atomic_task",), (), {"prompt": _fixed("predict subtask"), "atomic_task": _SUBTASK}),
    "future_subtask": Template(HEAD, SUBTASK, ("future_task",), (), {"prompt": _fixed("predict future subtask"), "atomic_task": _said("Subtask: ", "future_task")}),
    "boxes": Template(HEAD, BOXES, ("bbox",), ("bbox",), {"prompt": _fixed("predict bbox"), "bbox": _BOX_TEXT}, also=has_boxes, also_served=True),
    "boxes_subtask": Template(HEAD, BOXES_SUBTASK, ("bbox", "atomic_task"), (), {"prompt": _fixed("predict bbox, subtask and action"), "bbox": _BOX_TEXT, "atomic_task": _SUBTASK}, also=has_boxes),
    "trace": Template(HEAD, TRACE, ("trace_2d",), (), {"prompt": _fixed("predict 2d trace of gripper"), "trace_2d": _TRACE_TEXT}, also=sees_arm),
    "subtask_hint": Template(HEAD, SUBTASK_HINT, ("atomic_task", "action_hint"), (), {"prompt": _fixed("predict subtask and action hint"), "atomic_task": _SUBTASK, "action_hint": _said("ActionHint: ", "action_hint")}),
    "high_level_subtask": Template(HEAD, SUBTASK, ("high_level_instruction", "atomic_task"), ("high_level_instruction",), {"prompt": _fixed("predict subtask"), "atomic_task": _SUBTASK}, command="high_level_instruction"),
    "atomic_command": Template(HEAD, ACTION, ("atomic_task",), ("atomic_task",), command="atomic_task"),
    "memory_update": Template(MEMORY_HEAD, MEMORY_UPDATE, ("memory", "memory_update"), ("memory",), {"memory": _said("", "memory"), "memory_update": _update, "cotprefix": _fixed("Please output the updated memory:")}),
    "memory_subtask": Template(MEMORY_HEAD, MEMORY_SUBTASK, ("memory", "atomic_task"), ("memory",), {"memory": _said("", "memory"), "atomic_task": _SUBTASK, "memory_update": _update, "cotprefix": _fixed("Please output the subtask and updated memory:")}),
    "plan_step": Template(PLAN_HEAD, PLAN_STEP, ("plan", "plan_step"), ("plan",), {"plan": _said("", "plan"), "plan_step": _step, "cotprefix": _fixed("Please output the current plan step:")}),
}


def build(frames: DataFrame, weights: Mapping[str, float], key: str, images: int = 2, embodiment: str = "unknown", instruction: str | None = None, served_by: str | None = None, serving: bool = False, seed: int = 0) -> DataFrame:
    """Adds ``builder``, ``template``, ``command`` and ``slots`` to frames with ``task`` and any annotations.

    In training a template is drawn by weight from those of ``weights`` that apply to the frame, repeatably by key; in
    serving it is ``served_by`` where that applies.  Where none does it is ``base``.  ``instruction`` replaces the task in
    the command's slot; a template's own command column, where it is not null, replaces both.
    """
    if bad := [n for n, w in weights.items() if w <= 0]:
        raise ValueError(f"weights of {bad} are not above 0")
    names, had = list(weights), frames.columns
    wanted = sorted({"task", "memory", "memory_update", "atomic_task", "future_task", "bbox", "trace_2d", "action_hint", "high_level_instruction", "plan"} - set(had))
    f = frames.withColumns({n: F.lit(None).cast("string") for n in wanted} | ({} if "plan_step" in had else {"plan_step": F.lit(None).cast("long")}))
    if serving:
        name = F.when(TEMPLATES[served_by].applies(had, True), served_by).otherwise("base") if served_by else F.lit("base")
    else:
        pick = T.weighted_choice([TEMPLATES[n].applies(had) for n in names], [weights[n] for n in names], hashed_uniform(F.col(key), seed=seed)) if names else F.lit(None).cast("int")
        name = F.coalesce(F.get(F.array(*map(F.lit, [*names, "base"])), pick), F.lit("base"))
    f = f.withColumn("builder", name)
    used = dict.fromkeys(["base", *names, *([served_by] if served_by else [])])
    template, command = F.lit(None).cast("string"), F.lit(instruction) if instruction is not None else F.col("task")
    given, slots = command, F.create_map(F.lit("embodiment"), F.lit(embodiment))
    out = slots
    for n in used:
        t, here = TEMPLATES[n], F.col("builder") == n
        template = F.when(here, t.text(images)).otherwise(template)
        if t.command:
            command = F.when(here, F.coalesce(t.command, given)).otherwise(command)
        if t.slots:
            out = F.when(here, F.map_concat(slots, F.create_map(*(x for k, v in t.slots.items() for x in (F.lit(k), v()))))).otherwise(out)
    return f.withColumns({"template": template, "command": command, "slots": out}).drop(*(n for n in [*wanted, "plan_step"] if n not in had))


def rendered(template: Column, command: Column, slots: Column) -> Column:
    """The template with its text slots filled; image, state, action and control slots stay for the tokenizer."""
    out = F.replace(template, F.lit("<command_text_!_200>"), F.coalesce(command, F.lit("")))
    names = ("embodiment", "prompt", "cotprefix", "memory", "plan", "atomic_task", "bbox", "trace_2d", "action_hint", "memory_update", "plan_step")
    pairs = F.array(*(F.struct(F.lit(n).alias("n"), F.coalesce(F.try_element_at(slots, F.lit(n)), F.lit("")).alias("v")) for n in names))
    fill = lambda s, x: F.replace(F.replace(s, F.concat(F.lit("<"), x["n"], F.lit("_text_!>")), x["v"]), F.concat(F.lit("<"), x["n"], F.lit("_text>")), x["v"])
    return F.aggregate(pairs, out, fill)
