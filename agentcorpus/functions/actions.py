"""Browser actions: normalising raw ones, reading predicted ones, comparing the two.

Actions have an open set of arguments, so they travel as JSON text and are opened as VARIANT where
their types matter (``true`` must not pass for a number).  All functions here take the opened value:
callers parse each text once into a column of its own and refer to that.  Short flat texts, which are
almost all, have one reading only and are read as structs, at a fraction of the cost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentcorpus.functions.geometry import clamp
from agentcorpus.functions.staging import bound
from agentcorpus.functions.text import strip

POSITION_KEYS = ("x", "y", "from_x", "from_y", "to_x", "to_y")
DELTA_KEYS = ("delta_x", "delta_y")
ARGUMENTS = "struct<name:variant, " + ", ".join(
    f"{key}:variant" for key in (*POSITION_KEYS, *DELTA_KEYS)
) + ">"
RAW_ARGUMENTS = "struct<" + ", ".join(
    f"{key}:variant" for key in (*POSITION_KEYS, *DELTA_KEYS, "bbox", "button", "click_type")
) + ">"
FIELDS = "struct<name:string, " + ", ".join(
    f"{key}:double" for key in (*POSITION_KEYS, *DELTA_KEYS)
) + ">"
# One object: its name, then plain numbers and texts without escapes.  No key comes twice, and what
# should be a number is one.
_TEXT = r'"[^"\\\p{Cntrl}]*+"'
_INNER = r'"[^"\\}\p{Cntrl}]*+"'  # a brace inside would hide a repeated key behind it
_NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,15})?(?=[,}])"
_VALUE = rf'(?:{_NUMBER}|(?<!"(?:from_|to_|delta_)?[xy]": ?){_INNER})'
FLAT_OBJECT = (
    rf'\{{"name": ?{_TEXT}(?:, ?"(?!name")([a-z_]++)": ?{_VALUE}(?![^}}]*"\1":))*+\}}'
)
FLAT_ACTION = rf"^{FLAT_OBJECT}\z"
FLAT_PREDICTION = rf'^\{{"thought": ?{_TEXT}, ?"action": ?{FLAT_OBJECT}\}}\z'
# The same with a text or a truth value where a number should be: valid JSON, but no valid action.
_ANY = rf"(?:{_NUMBER}|{_INNER}|true|false)"
MISTYPED_PREDICTION = (
    rf'^\{{"thought": ?{_TEXT}, ?"action": ?\{{"name": ?{_TEXT}'
    rf'(?:, ?"(?!name")([a-z_]++)": ?{_ANY}(?![^}}]*"\1":))*+\}}\}}\z'
)
MISTYPED_NUMBER = r'"(?:from_|to_|delta_)?[xy]": ?["tf]'
# The one argument of an action that has no other, where it is a text: its key, and the text.
_ONE_TEXT = rf'\{{"name": ?{_INNER}, ?"(?!name")([a-z_]++)": ?({_INNER})\}}'
ONE_TEXT = rf"^{_ONE_TEXT}\z"
ONE_TEXT_PREDICTION = rf'^\{{"thought": ?{_TEXT}, ?"action": ?{_ONE_TEXT}\}}\z'
PROSE = "^(?!true|false|null|NaN|Inf)[A-Za-z]"  # words are no JSON, whatever follows
FLAT_CHARS = 1000
ONE_OBJECT = "^\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)?\\}$"
CLICK_TOLERANCE_PX = 25.0
SCROLL_TOLERANCE = 10.0


def opened(json_text: Column) -> Column:
    return F.try_parse_json(json_text)


def strictly_opened(json_text: Column) -> Column:
    """Null unless the whole text is one JSON value.

    The parser stops after the first value.  One object with at most one object inside cannot hide a
    tail, and is parsed once.  Any other text is tried inside brackets and inside braces: a tail can
    slip through one of them, but never through both.
    """
    simple = json_text.rlike(ONE_OBJECT)
    listed = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), json_text, F.lit("}")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull()
    only = F.size(F.try_variant_get(keyed, "$", "map<string,variant>")) == 1
    return F.when(simple, F.try_parse_json(json_text)).when(
        single & only, F.try_variant_get(listed, "$[0]", "variant")
    )


def _flat(json_text: Column, pattern: str) -> Column:
    return (F.length(json_text) <= FLAT_CHARS) & json_text.rlike(pattern)


def flat_action(json_text: Column) -> Column:
    """:func:`action_fields` of the text of a short flat action; null for any other text."""
    return F.when(_flat(json_text, FLAT_ACTION), F.from_json(json_text, FIELDS))


def flat_prediction(json_text: Column) -> Column:
    """Fields of the action in the text of a short flat prediction; null for any other text."""
    read = F.from_json(json_text, f"struct<action:{FIELDS}>")
    return F.when(_flat(json_text, FLAT_PREDICTION), read["action"])


def child(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    """JSON numbers are whole, decimal or floating; booleans and texts are not numbers."""
    kind = type_of(value)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))


def number(value: Column) -> Column:
    """Double of a JSON number; null for anything else, booleans and infinities included."""
    parsed = F.try_variant_get(value, "$", "double")
    return F.when(type_of(value) == "BIGINT", parsed).when(  # whole ones are finite
        is_number(value) & (F.abs(parsed) < float("inf")), parsed
    )


def text(value: Column) -> Column:
    return F.when(type_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def is_object(value: Column) -> Column:
    return F.coalesce(type_of(value).startswith("OBJECT"), F.lit(False))


def _scaled(value: Column, size: Column, clamped: bool) -> Column:
    percent = value / F.when(size > 0, size) * 100.0
    return F.bround(clamp(percent, 0.0, 100.0) if clamped else percent, 1)


def normalize_action(name: Column, value: Column, width: Column, height: Column) -> Column:
    """Raw action (name and opened arguments) to the 0-100 scale.

    Returns a struct of ``action`` (JSON text) and ``box`` (xyxy pixels, clicks only); ``action`` is
    null when the raw action is unusable, which drops the step.
    """
    known = F.try_variant_get(value, "$", RAW_ARGUMENTS)

    def read(k):
        numbers = [
            F.when(k[key].isNotNull(), number(k[key])).alias(key)
            for key in (*POSITION_KEYS, *DELTA_KEYS)
        ]
        entries = F.try_variant_get(k["bbox"], "$", "array<variant>")
        parts = bound(entries, lambda e: F.when(F.size(e) == 4, F.transform(e, number)))
        labels = [
            F.coalesce(F.try_variant_get(k[key], "$", "string"), F.lit("")).alias(key)
            for key in ("button", "click_type")
        ]
        return F.struct(
            *numbers, *labels, k.isNotNull().alias("usable"),
            (k["bbox"].isNotNull() & (type_of(k["bbox"]) != "VOID")).alias("has_box"),
            F.when(k["bbox"].isNotNull(), parts).alias("parts"),
        )

    return bound(
        bound(known, read), lambda k: _normalized(name, value, k, {"x": width, "y": height})
    )


def _normalized(name: Column, value: Column, k: Column, sides: dict[str, Column]) -> Column:
    """:func:`normalize_action` from the known arguments ``k``, each read once."""

    def coordinate(key):
        return _scaled(k[key], sides[key[-1]], True)

    def delta(key):
        return _scaled(k[key], sides[key[-1]], False)

    bx, by, bw, bh = [F.get(k["parts"], F.lit(i)) for i in range(4)]
    box_ok = bx.isNotNull() & by.isNotNull() & (bw > 0) & (bh > 0)
    click_x = F.when(k["has_box"], F.when(box_ok, bx + bw / 2.0)).otherwise(k["x"])
    click_y = F.when(k["has_box"], F.when(box_ok, by + bh / 2.0)).otherwise(k["y"])

    def named(fields: dict[str, Column]) -> Column:
        required = [key for key in fields if key not in ("button", "click_type")]
        body = F.struct(name.alias("name"), *[c.alias(key) for key, c in fields.items()])

        def written(b):
            complete = b[required[0]].isNotNull()
            for key in required[1:]:
                complete = complete & b[key].isNotNull()
            return F.when(complete, F.to_json(b))

        return bound(body, written)

    click = named(
        {
            "x": _scaled(click_x, sides["x"], True),
            "y": _scaled(click_y, sides["y"], True),
            "button": k["button"],
            "click_type": k["click_type"],
        }
    )
    scroll = named({key: delta(key) for key in DELTA_KEYS})
    scroll_at = named(
        {"x": coordinate("x"), "y": coordinate("y"), **{key: delta(key) for key in DELTA_KEYS}}
    )
    drag = named({key: coordinate(key) for key in POSITION_KEYS[2:]})
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    others = F.map_filter(entries, lambda key, _: ~key.isin("bbox", "name"))
    body = bound(
        F.to_json(others),
        lambda rest: F.when(rest == "{}", F.lit("}")).otherwise(
            F.concat(F.lit(","), F.substr(rest, F.lit(2)))
        ),
    )
    plain = F.concat(
        F.lit('{"name":'), F.get_json_object(F.to_json(F.array(name)), "$[*]"), body
    )
    action = (
        F.when(name == "click", click)
        .when(name == "scroll", scroll)
        .when(name == "scroll_at", scroll_at)
        .when(name == "mouse_drag_and_drop", drag)
        .otherwise(plain)
    )
    box = F.when(
        (name == "click") & k["has_box"] & box_ok, F.array(bx, by, bx + bw, by + bh)
    )
    return F.struct(
        F.when((name != "") & k["usable"], action).alias("action"), box.alias("box")
    )


def action_bbox(box: Column, width: Column, height: Column) -> Column:
    """Pixel xyxy to 0-1 xyxy, unrounded."""
    return F.when(
        box.isNotNull(),
        F.array(box[0] / width, box[1] / height, box[2] / width, box[3] / height),
    )


def argument_error(name: Column, bad_number: Column) -> Column:
    """Why the arguments of a predicted action do not hold; null when they do."""
    blank = F.coalesce(strip(name), F.lit("")) == ""
    return F.when(blank, F.lit("missing_name")).when(bad_number, F.lit("bad_coordinate"))


def flat_error(fields: Column) -> Column:
    """:func:`prediction_error` of a flat prediction, whose numbers are numbers."""
    bad_number = F.lit(False)
    for key in POSITION_KEYS:
        bad_number = bad_number | (fields[key].isNotNull() & ~fields[key].between(0, 100))
    return argument_error(fields["name"], bad_number)


def action_arguments(action: Column) -> Column:
    """The known arguments of an opened action, all found in one pass over it."""
    return F.try_variant_get(action, "$", ARGUMENTS)


def action_fields(arguments: Column) -> Column:
    """Name and numeric values of :func:`action_arguments`."""
    keys = (*POSITION_KEYS, *DELTA_KEYS)
    return F.struct(
        text(arguments["name"]).alias("name"),
        *[
            F.when(arguments[key].isNotNull(), number(arguments[key])).alias(key) for key in keys
        ],
    )


def prediction_error(
    payload: Column, action: Column, arguments: Column, fields: Column
) -> Column:
    """Why an opened prediction is not exactly ``{thought, action}``; null when it is."""
    keys = F.map_keys(F.try_variant_get(payload, "$", "map<string,variant>"))
    bad_number = F.lit(False)
    for key in (*POSITION_KEYS, *DELTA_KEYS):
        parsed = fields[key]
        good = parsed.isNotNull() if key in DELTA_KEYS else parsed.between(0, 100)
        bad_number = bad_number | (arguments[key].isNotNull() & ~F.coalesce(good, F.lit(False)))
    return (
        F.when(payload.isNull(), F.lit("invalid_json"))
        .when(~is_object(payload), F.lit("not_thought_and_action"))
        .when(
            F.sort_array(keys) != F.array(F.lit("action"), F.lit("thought")),
            F.lit("not_thought_and_action"),
        )
        .when(text(child(payload, "thought")).isNull() | ~is_object(action), F.lit("wrong_types"))
        .otherwise(argument_error(fields["name"], bad_number))
    )


def read_prediction(text: Column) -> Column:
    """Struct of ``error`` and, of valid predictions, ``fields`` and (unless flat) ``action``."""

    def judged(payload, action, known, fields):
        error = prediction_error(payload, action, known, fields)
        return bound(error, lambda e: _prediction(e, fields, action))

    other = bound(
        strictly_opened(text),
        lambda payload: bound(
            child(payload, "action"),
            lambda action: bound(
                action_arguments(action),
                lambda known: bound(
                    action_fields(known), lambda fields: judged(payload, action, known, fields)
                ),
            ),
        ),
    )
    nothing = opened(F.lit(None).cast("string"))

    def read(flat):
        short = bound(flat_error(flat), lambda e: _prediction(e, flat, nothing))
        mistyped = argument_error(F.get_json_object(text, "$.action.name"), F.lit(True))
        return (
            F.when(flat.isNotNull(), short)
            .when(text.rlike(PROSE), _prediction(F.lit("invalid_json"), flat, nothing))
            .when(
                _flat(text, MISTYPED_PREDICTION) & text.rlike(MISTYPED_NUMBER),
                _prediction(mistyped, flat, nothing),
            )
            .otherwise(other)
        )

    return bound(flat_prediction(text), read)


def _prediction(error: Column, fields: Column, action: Column) -> Column:
    return F.struct(
        error.alias("error"),
        F.when(error.isNull(), fields).alias("fields"),
        F.when(error.isNull(), action).alias("action"),
    )


def whole_action(text: Column, read: Column) -> Column:
    """Action of a predicted text as VARIANT; flat ones are opened here, where something needs it."""
    whole = F.coalesce(read["action"], child(opened(text), "action"))
    return F.when(read["fields"].isNotNull(), whole)


def read_target(text: Column) -> Column:
    """Struct of the ``fields`` and the ``name`` of a target action."""

    def read(flat):
        fields = bound(action_arguments(opened(text)), action_fields)
        name = F.get_json_object(text, "$.name")
        return F.when(
            flat.isNotNull(), F.struct(flat.alias("fields"), flat["name"].alias("name"))
        ).otherwise(F.struct(fields.alias("fields"), name.alias("name")))

    return bound(flat_action(text), read)


def equal_actions(text: Column, read: Column, target_text: Column, target: Column) -> Column:
    """Whether all arguments of a predicted and a target action agree, null where that is open.

    Unequal numbers, equal texts and single texts settle almost every row without the full comparison.
    """
    singles = ((text, ONE_TEXT_PREDICTION), (target_text, ONE_TEXT))
    key, only = [
        reduce(Column.__eq__, [F.regexp_extract(one, form, group) for one, form in singles])
        for group in (1, 2)
    ]
    tail = F.concat(F.lit('"action":'), target_text, F.lit("}"))
    return (
        F.when(~read["fields"].eqNullSafe(target["fields"]), F.lit(False))
        .when(read["action"].isNull() & F.endswith(text, tail), F.lit(True))
        .when(reduce(Column.__and__, [_flat(one, form) for one, form in singles]), key & only)
        .otherwise(same_arguments(whole_action(text, read), opened(target_text)))
    )


def same_arguments(left: Column, right: Column) -> Column:
    """Whether all arguments of two opened actions agree; equal texts settle most."""

    def same(pair):
        a, b = pair["a"], pair["b"]
        return F.when(F.to_json(a) == F.to_json(b), F.lit(True)).otherwise(
            canonical_arguments(a) == canonical_arguments(b)
        )

    return bound(F.struct(left.alias("a"), right.alias("b")), same)


def canonical_arguments(action: Column) -> Column:
    """Comparable text of an action's arguments: sorted keys, and numbers compared by value."""
    entries = F.map_filter(
        F.try_variant_get(action, "$", "map<string,variant>"), lambda key, _: key != "name"
    )
    return F.to_json(
        F.array_sort(
            F.transform(
                F.map_entries(entries),
                lambda item: F.struct(
                    item["key"].alias("k"),
                    F.coalesce(
                        number(item["value"]).cast("string"), F.to_json(item["value"])
                    ).alias("v"),
                ),
            )
        )
    )


def _gap(p: Column, t: Column, prefix: str, width: Column, height: Column) -> Column:
    x, y = f"{prefix}x", f"{prefix}y"
    return F.hypot((p[x] - t[x]) / 100.0 * width, (p[y] - t[y]) / 100.0 * height)


def compare_clicks(
    p: Column, t: Column, box: Column, width: Column, height: Column
) -> dict[str, Column]:
    """Agreement of names, click distance and click-in-box of predicted (``p``) and target fields."""
    name = t["name"]
    same_name = F.coalesce(p["name"] == name, F.lit(False))
    x, y = p["x"] / 100.0 * width, p["y"] / 100.0 * height
    inside = F.when(
        same_name & (name == "click") & (F.size(box) > 0) & p["x"].isNotNull() & p["y"].isNotNull(),
        x.between(box[0] * width, box[2] * width) & y.between(box[1] * height, box[3] * height),
    )
    return {
        "action_name_correct": same_name,
        "click_distance_px": F.when(
            same_name & name.isin("click", "scroll_at"), _gap(p, t, "", width, height)
        ),
        "click_inside_bbox": inside,
    }


def compare_arguments(
    p: Column, t: Column, equal: Column, clicks: Column, box: Column, width: Column, height: Column
) -> dict[str, Column]:
    """Agreement of arguments and of whole actions, given a struct of :func:`compare_clicks`.

    ``equal`` tells whether all arguments agree.
    """
    name, same_name = t["name"], clicks["action_name_correct"]
    distance = clicks["click_distance_px"]
    has_box = F.coalesce(F.size(box) > 0, F.lit(False))
    deltas = F.lit(True)
    for key in DELTA_KEYS:
        deltas = deltas & (F.abs(p[key] - t[key]) <= SCROLL_TOLERANCE)
    drag = (_gap(p, t, "from_", width, height) <= CLICK_TOLERANCE_PX) & (
        _gap(p, t, "to_", width, height) <= CLICK_TOLERANCE_PX
    )
    arguments = (
        F.when(~same_name, F.lit(False))
        .when(
            name == "click",
            F.when(has_box, clicks["click_inside_bbox"]).otherwise(distance <= CLICK_TOLERANCE_PX),
        )
        .when(name.isin("scroll", "scroll_at"), ((name == "scroll") | (distance <= CLICK_TOLERANCE_PX)) & deltas)
        .when(name == "mouse_drag_and_drop", drag)
        .otherwise(equal)
    )
    return {
        "action_arguments_correct": F.coalesce(arguments, F.lit(False)),
        "action_exact": F.coalesce(same_name & equal, F.lit(False)),
    }


def rollout_action(value: Column) -> Column:
    """Opened dataset action to the minimal environment action, or an error when it has none."""
    name = text(child(value, "name"))
    x = F.try_variant_get(value, "$.x", "double") / 100.0
    y = F.try_variant_get(value, "$.y", "double") / 100.0
    typed = text(child(value, "text"))
    dy = F.try_variant_get(value, "$.delta_y", "double")
    message = text(child(value, "msg"))
    for prefix in ("[ANSWER]", "[EXIT]"):
        message = F.when(
            message.startswith(prefix), strip(F.substr(message, F.lit(len(prefix) + 1)))
        ).otherwise(message)
    error = (
        F.when(~is_object(value), F.lit("no_action"))
        .when((name == "click") & (x.isNull() | y.isNull()), F.lit("click_needs_position"))
        .when(
            (name == "keyboard_type") & (F.coalesce(typed, F.lit("")) == ""),
            F.lit("type_needs_text"),
        )
        .when((name == "scroll") & (F.coalesce(dy, F.lit(0.0)) == 0), F.lit("scroll_needs_delta"))
        .when((name == "send_msg_to_user") & message.isNull(), F.lit("message_needs_text"))
        .when(
            ~F.coalesce(
                name.isin("click", "keyboard_type", "scroll", "go_back", "send_msg_to_user"),
                F.lit(False),
            ),
            F.lit("unsupported"),
        )
    )
    kind = (
        F.when(name == "click", "click")
        .when(name == "keyboard_type", "type")
        .when(name == "scroll", "scroll")
        .when(name == "go_back", "go_back")
        .when(name == "send_msg_to_user", "done")
    )
    ok = error.isNull()
    scroll = ok & (name == "scroll")
    return F.struct(
        F.when(ok, kind).alias("action"),
        F.when(ok & (name == "click"), x).alias("x"),
        F.when(ok & (name == "click"), y).alias("y"),
        F.when(ok & (name == "keyboard_type"), typed).alias("text"),
        F.when(scroll, F.when(dy > 0, "down").otherwise("up")).alias("direction"),
        F.when(scroll, F.least(F.abs(dy) / 100.0, F.lit(1.0))).alias("amount"),
        F.when(ok & (name == "send_msg_to_user"), message).alias("result"),
        error.alias("error"),
    )


# ---- fixed values: argument names of each environment action --------------------------------
POLICY_FIELDS = {
    "click": ("action", "x", "y"),
    "type": ("action", "text"),
    "scroll": ("action", "amount", "direction"),
    "go_back": ("action",),
    "done": ("action", "result"),
}
# ---------------------------------------------------------------------------------------------


def policy_action_error(value: Column) -> Column:
    """Why an opened policy output is not one strict environment action; null when it is."""
    name = text(child(value, "action"))
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    keys = F.array_join(F.sort_array(F.map_keys(entries)), ",")
    wrong_fields = F.lit(False)
    for action, fields in POLICY_FIELDS.items():
        wrong_fields = wrong_fields | ((name == action) & (keys != ",".join(sorted(fields))))
    x, y = number(child(value, "x")), number(child(value, "y"))
    amount = number(child(value, "amount"))
    direction = text(child(value, "direction"))

    def fails(condition):
        return ~F.coalesce(condition, F.lit(False))

    return (
        F.when(value.isNull(), F.lit("invalid_json"))
        .when(~is_object(value), F.lit("not_an_object"))
        .when(fails(name.isin(*POLICY_FIELDS)), F.lit("unsupported_action"))
        .when(wrong_fields, F.lit("invalid_fields"))
        .when(
            (name == "click") & fails(x.between(0, 1) & y.between(0, 1)),
            F.lit("click_out_of_range"),
        )
        .when((name == "type") & fails(text(child(value, "text")) != ""), F.lit("empty_text"))
        .when((name == "scroll") & fails(direction.isin("up", "down")), F.lit("bad_direction"))
        .when((name == "scroll") & fails((amount > 0) & (amount <= 1)), F.lit("bad_amount"))
        .when((name == "done") & text(child(value, "result")).isNull(), F.lit("result_not_text"))
    )


def action_answer(thought: Column, action: Column) -> Column:
    """Compact ``{"thought":…,"action":…}`` text with the action's key order kept."""
    quoted = F.regexp_extract(F.to_json(F.struct(thought.alias("t"))), '(?s)^\\{"t":(.*)\\}$', 1)
    return F.concat(F.lit('{"thought":'), quoted, F.lit(',"action":'), action, F.lit("}"))
