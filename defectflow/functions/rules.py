"""Topic names and action rules as data, compiled to ordinary columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARROW = " → "

# Cluster id -> label shown when serving.
SERVING_TOPICS = {
    0: "valve leakage & insulation / alignment defects",
    1: "structural steel perforation & severe corrosion",
    2: "piping atmospheric corrosion & pitting",
    3: "bolt & flange thick-scale corrosion",
    4: "grating / studbolt corrosion & missing supports",
    5: "bolt nut depletion & poor thread engagement",
    6: "flange severe wall loss",
}
# Cluster id -> label the action rules are keyed on.
RULE_TOPICS = {
    0: "Pump/Mechanical Failures",
    1: "Valve Operations",
    2: "Leakage/Corrosion",
    3: "Electrical/Instrumentation",
    4: "Piping/Structural",
    5: "Operational Issues",
    6: "Preventive Maintenance",
}
# Fixed values: (topic, any of these keywords or () for always, actions). The
# first match wins.
ACTION_RULES = (
    ("Pump/Mechanical Failures", ("leak",),
     ("Isolate pump", "Inspect mechanical seal", "Replace seal if damaged", "Pressure test")),
    ("Pump/Mechanical Failures", ("vibration",),
     ("Check alignment", "Inspect bearings", "Balance impeller", "Tighten foundation bolts")),
    ("Pump/Mechanical Failures", (),
     ("Inspect pump", "Check mechanical components", "Perform necessary repairs")),
    ("Valve Operations", ("stuck", "seized"),
     ("Apply penetrating oil", "Work valve manually", "Disassemble if necessary", "Lubricate")),
    ("Valve Operations", (),
     ("Inspect valve", "Check actuator", "Test operation", "Calibrate as needed")),
    ("Leakage/Corrosion", (),
     ("Isolate affected area", "Assess corrosion extent", "Clean surface", "Apply protective coating",
      "Monitor regularly")),
    ("Electrical/Instrumentation", (),
     ("Verify power supply", "Inspect wiring connections", "Test signal integrity", "Calibrate instrument",
      "Replace if faulty")),
    ("Piping/Structural", (),
     ("Inspect pipe support condition", "Check for misalignment", "Verify pipe wall thickness",
      "Reinforce as needed")),
    ("Operational Issues", (),
     ("Review operating parameters", "Check process conditions", "Adjust settings if required",
      "Monitor performance")),
    ("Preventive Maintenance", (),
     ("Follow scheduled inspection", "Perform preventive tasks", "Replace worn components",
      "Update maintenance records")),
)
DEFAULT_ACTIONS = ("Inspect equipment", "Assess condition", "Determine required action", "Report findings")


def topic_tag(cluster_id: Column, tags: dict[int, str] = SERVING_TOPICS) -> Column:
    """Label of a cluster id, ``Unknown Cluster (id)`` when it has none."""
    lookup = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    return F.coalesce(
        F.try_element_at(lookup, cluster_id.cast("int")),
        F.concat(F.lit("Unknown Cluster ("), cluster_id.cast("string"), F.lit(")")),
    )


def action_sequence(topic: Column, text: Column, rules=ACTION_RULES, default=DEFAULT_ACTIONS) -> Column:
    """Actions for a rule topic and a text, as ``array<string>``."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    chain = None
    for rule_topic, keywords, actions in rules:
        condition = topic == rule_topic
        if keywords:
            hit = lowered.contains(keywords[0])
            for word in keywords[1:]:
                hit = hit | lowered.contains(word)
            condition = condition & hit
        value = F.array(*[F.lit(a) for a in actions])
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    fallback = F.array(*[F.lit(a) for a in default])
    return fallback if chain is None else chain.otherwise(fallback)


def default_workflow(topic: Column, cleaned: Column, rules=ACTION_RULES, default=DEFAULT_ACTIONS) -> Column:
    """``action_sequence``, but empty text always gets the general actions."""
    empty = F.coalesce(cleaned, F.lit("")) == ""
    return F.when(empty, F.array(*[F.lit(a) for a in default])).otherwise(
        action_sequence(topic, cleaned, rules, default)
    )


def join_actions(actions: Column) -> Column:
    return F.array_join(actions, ARROW)


def split_actions(text: Column) -> Column:
    return F.split(text, ARROW)


def numbered_steps(actions: Column) -> Column:
    """``[STEPS:N] Actions: 1. first 2. second`` from an action array."""
    lines = F.transform(
        actions, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)
    )
    return F.concat(F.lit("[STEPS:"), F.size(actions).cast("string"), F.lit("] Actions: "), F.array_join(lines, " "))


def parse_steps(text: Column) -> Column:
    """Struct ``declared, steps array<struct<step, action>>, consistent``.

    A number with a point begins a step if it is the first one or follows the
    number of the step before; others, such as amounts, belong to the action.
    ``consistent`` is false when the announced count and the listed steps
    differ, or when there is no announcement.
    """
    text = F.coalesce(text, F.lit(""))
    declared = F.try_to_number(F.regexp_extract(text, r"\[STEPS:(\d+)\]", 1), F.lit("999999999")).cast("int")
    body = F.regexp_replace(text, r"^\s*(\[STEPS:\d+\])?\s*(Actions:)?\s*", "")
    marker = r"(?:^|\s+)\d+\.\s+"
    numbers = F.regexp_extract_all(body, F.lit(r"(?:^|\s)(\d+)\.\s"), F.lit(1))
    pieces = F.split(body, marker)
    actions = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.trim)
    marked = F.zip_with(numbers, actions, lambda n, a: F.struct(n.alias("mark"), a.alias("action")))
    empty = F.array().cast("array<struct<step:int,action:string>>")

    def take(steps, piece):
        number = piece["mark"].try_cast("int")
        last = F.try_element_at(steps, F.lit(-1))
        new = F.concat(steps, F.array(F.struct(number.alias("step"), piece["action"].alias("action"))))
        joined = F.concat(
            F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))),
            F.array(F.struct(last["step"].alias("step"), F.trim(
                F.concat(last["action"], F.lit(" "), piece["mark"], F.lit(". "), piece["action"])
            ).alias("action"))),
        )
        starts = F.size(steps) == 0
        return F.when(number.isNull() & starts, steps).when(starts | (number == last["step"] + 1), new).otherwise(joined)

    steps = F.aggregate(marked, empty, take)
    return F.struct(
        declared.alias("declared"),
        steps.alias("steps"),
        F.coalesce(declared == F.size(steps), F.lit(False)).alias("consistent"),
    )
