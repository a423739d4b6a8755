"""Scores of predictions, per row and summarised."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions import actions, geometry
from agentcorpus.functions.points import with_point
from agentcorpus.functions.staging import bound, staged
from agentcorpus.functions.text import answer_tokens, blank_to, overlap_f1, strip
from agentcorpus.operators import records
from agentcorpus.operators.audit import macro_metric
from agentcorpus.operators.ranking import exact_median
from agentcorpus.operators.rows import single_row
from agentcorpus.session import cut

THRESHOLDS = (25, 50, 100)
TASKS = ("qa", "grounding", "action")
CLICKS = ("action_name_correct", "click_distance_px", "click_inside_bbox")
# primary boolean metrics of a mixed evaluation: name -> (task, column)
PRIMARY = {
    "qa_answer_accuracy": ("qa", "exact_match"),
    "grounding_click_accuracy": ("grounding", "within_element_bounds"),
    "action_name_accuracy": ("action", "action_name_correct"),
    "action_exact_accuracy": ("action", "action_exact"),
}


def _prediction(df: DataFrame) -> Column:
    return F.coalesce(records.optional(df, "prediction"), F.lit(""))


def qa_score(df: DataFrame) -> DataFrame:
    """Exact match, token F1 and error category."""
    # Tokens are formed once per text and used by both scores.
    tokens = staged(
        df, {"_p": answer_tokens(_prediction(df)), "_e": answer_tokens(F.col("answer"))}
    )
    exact = F.coalesce(F.concat_ws(" ", "_p") == F.concat_ws(" ", "_e"), F.lit(False))
    kind = F.lower(records.field_or(df, "question_type"))
    reading = kind.contains("ocr") | kind.contains("text") | kind.contains("read")
    category = F.when(~F.col("exact_match"), F.when(reading, "ocr").otherwise("semantic_understanding"))
    scored = staged(
        tokens, {"exact_match": exact, "token_f1": overlap_f1(F.col("_p"), F.col("_e"))}
    )
    return scored.withColumn("error_category", category).drop("_p", "_e")


def parse_grounding_predictions(df: DataFrame) -> DataFrame:
    return with_point(df, _prediction(df), "parsed_point").withColumn(
        "parse_error", F.when(F.col("parsed_point").isNull(), F.lit("output_format"))
    )


def grounding_score(df: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    parsed = parse_grounding_predictions(df).drop("parse_error")
    point = F.col("parsed_point")
    ok = point.isNotNull()
    on_grid = ok & point[0].between(0, 1000) & point[1].between(0, 1000)
    hit = on_grid & geometry.point_in_bbox(point, F.col("bbox_normalized"))
    gap = geometry.pixel_distance(
        point, F.col("target_point_normalized"), F.col("image_width"), F.col("image_height")
    )
    scored = staged(
        parsed,
        {
            "parse_success": ok,
            "point_on_grid": F.coalesce(on_grid, F.lit(False)),
            "within_element_bounds": F.coalesce(hit, F.lit(False)),
            "pixel_distance": F.when(ok, gap),
        },
    )
    category = F.when(~F.col("parse_success"), "output_format").when(
        ~F.col("within_element_bounds"), "spatial_grounding"
    )
    return scored.withColumns(
        {
            "error_category": category,
            **{
                f"within_{t}px": F.coalesce(F.col("pixel_distance") <= t, F.lit(False))
                for t in thresholds
            },
        }
    )


def parse_action_predictions(df: DataFrame) -> DataFrame:
    """Strict reading of predicted actions: ``parsed_action`` as JSON text and ``parse_error``."""
    text = strip(_prediction(df))
    read = staged(df, {"_read": actions.read_prediction(text)})
    whole = F.to_json(actions.whole_action(text, F.col("_read")))
    return read.withColumns(
        {"parse_error": F.col("_read.error"), "parsed_action": whole}
    ).drop("_read")


def parse_policy_outputs(steps: DataFrame, column: str = "raw_policy_output") -> DataFrame:
    opened = staged(steps, {"_value": actions.strictly_opened(F.col(column))})
    return staged(opened, {"parse_error": actions.policy_action_error(F.col("_value"))}).drop(
        "_value"
    )


def parse_error_summary(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    return parsed.groupBy(*by, F.coalesce("parse_error", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def parse_error_rate(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count("parse_error").alias("parse_errors"),
        F.avg(F.col("parse_error").isNotNull().cast("double")).alias("parse_error_rate"),
    )


def action_error_category(df: DataFrame, name: Column | None = None) -> Column:
    """Category of a scored row; ``name`` is the name of its target action, where it is at hand."""
    name = F.get_json_object("target_action", "$.name") if name is None else name
    boxed = F.coalesce(F.size("bbox_normalized") > 0, F.lit(False))
    return (
        F.when(~F.col("action_parse_valid"), "output_format")
        .when(~F.col("action_name_correct"), "semantic_action")
        .when(
            (name == "click") & boxed & ~F.coalesce(F.col("click_inside_bbox"), F.lit(False)),
            "spatial_grounding",
        )
        .when(~F.col("action_arguments_correct"), "action_arguments")
        .otherwise("correct")
    )


def action_score(df: DataFrame) -> DataFrame:
    """Agreement of each predicted action with its target, read and compared in one step."""
    box, sides = F.col("bbox_normalized"), (F.col("image_width"), F.col("image_height"))
    predicted, target = strip(_prediction(df)), F.col("target_action")

    def named(columns):
        return [column.alias(name) for name, column in columns.items()]

    def compared(text, read, wanted):
        p, t = read["fields"], wanted["fields"]
        equal = actions.equal_actions(text, read, target, wanted)
        clicks = F.struct(*named(actions.compare_clicks(p, t, box, *sides)), equal.alias("equal"))
        return bound(
            clicks,
            lambda c: F.struct(
                *[c[name].alias(name) for name in CLICKS],
                *named(actions.compare_arguments(p, t, c["equal"], c, box, *sides)),
                read.alias("read"), wanted["name"].alias("target_name"),
            ),
        )

    found = bound(
        predicted,
        lambda text: bound(
            actions.read_prediction(text),
            lambda read: bound(
                actions.read_target(target), lambda wanted: compared(text, read, wanted)
            ),
        ),
    )
    made = staged(df, {"_found": found})
    read, error = F.col("_found.read"), F.col("_found.read.error")
    names = (*CLICKS, "action_arguments_correct", "action_exact", "target_name")
    scored = made.withColumns(
        {
            **{name: F.col(f"_found.{name}") for name in names},
            "parsed_action": F.to_json(actions.whole_action(predicted, read)),
            "action_parse_error": error, "action_parse_valid": error.isNull(),
        }
    ).drop("_found")
    click = F.col("target_name") == "click"
    boxed = click & F.coalesce(F.size("bbox_normalized") > 0, F.lit(False))
    return scored.withColumns(
        {
            "error_category": action_error_category(scored, F.col("target_name")),
            "click_target": F.coalesce(click, F.lit(False)),
            "boxed_target": F.coalesce(boxed, F.lit(False)),
        }
    )


# ---- summaries ------------------------------------------------------------------------------


def rate(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def _moments(parts: dict[str, Column]) -> list[Column]:
    """Sum and count of each value: what means of any coarser grouping are made of."""
    return [
        column
        for name, value in parts.items()
        for column in (
            F.sum(value.cast("double")).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")
        )
    ]


def _mean(name: str, default: float | None = 0.0) -> Column:
    value = F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_sum") / F.col(f"{name}_n"))
    return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)


def _share(condition: Column, hit: Column) -> Column:
    return F.when(condition, F.coalesce(hit, F.lit(False)).cast("double"))


def _summary_parts(task: str, thresholds: Sequence[int]) -> tuple[dict, dict, str | None, str]:
    """(means with 0 where undefined, means with null, value of the median, its name) of a task."""
    if task == "qa":
        return {"answer_accuracy": F.col("exact_match"), "mean_token_f1": F.col("token_f1")}, {}, None, ""
    if task == "grounding":
        given = F.when(F.col("parse_success"), F.col("within_element_bounds").cast("double"))
        means = {
            "parse_rate": F.col("parse_success"),
            "point_on_grid_rate": F.col("point_on_grid"),
            "click_accuracy": F.col("within_element_bounds"),
            "click_accuracy_given_parse": given,
            "mean_pixel_distance": F.col("pixel_distance"),
            **{f"accuracy_within_{t}px": F.col(f"within_{t}px") for t in thresholds},
        }
        return means, {}, "pixel_distance", "median_pixel_distance"
    means = {
        "json_parse_rate": F.col("action_parse_valid"),
        "action_name_accuracy": F.col("action_name_correct"),
        "action_argument_accuracy": F.col("action_arguments_correct"),
        "exact_action_accuracy": F.col("action_exact"),
    }
    boxed, click, gap = F.col("boxed_target"), F.col("click_target"), F.col("click_distance_px")
    optional = {
        "click_inside_bbox_accuracy": _share(boxed, F.col("click_inside_bbox")),
        **{f"click_within_{t}px_accuracy": _share(click, gap <= t) for t in thresholds},
    }
    return means, optional, "click_distance_px", "click_median_distance_px"


def _summarise(
    scored: DataFrame, by: Sequence[str], task: str, thresholds: Sequence[int] = THRESHOLDS,
    regroup=None, base: Sequence[str] | None = None,
) -> DataFrame:
    """Summary of a task per ``by``.

    Rows are summed once per ``base`` (``by`` itself unless given); ``regroup`` repeats those few
    sums, and the counts of equal distances, for every coarser group.
    """
    base = list(by if base is None else base)
    regroup = regroup or (lambda df: df)
    means, optional, value, out = _summary_parts(task, thresholds)
    sums = [F.count(F.lit(1)).alias("examples"), *_moments({**means, **optional})]
    if task == "action":
        sums += [
            F.count_if(F.col("boxed_target")).alias("click_target_examples_with_bbox"),
            F.count("click_distance_px").alias("click_predictions_with_distance"),
        ]
    first = _grouped(scored, base).agg(*sums)
    added = [c for c in first.columns if c not in base]
    total = _grouped(regroup(first), by).agg(*[F.sum(c).alias(c) for c in added])
    shown = {name: _mean(name) for name in means} | {name: _mean(name, None) for name in optional}
    if task == "action":
        count = ["click_target_examples_with_bbox", "click_predictions_with_distance"]
        parts = [
            *[shown[name] for name in means], count[0], shown["click_inside_bbox_accuracy"], count[1],
            *[shown[name] for name in optional if name != "click_inside_bbox_accuracy"],
        ]
    else:
        parts = list(shown.values())
    whole = F.coalesce("examples", F.lit(0)).alias("examples")  # an empty table has no sums
    summary = total.select(*by, whole, *parts)
    if value is None:
        return summary
    counted = _grouped(scored.where(F.col(value).isNotNull()), [*base, value]).agg(
        F.count(F.lit(1)).alias("_weight")
    )
    median = exact_median(regroup(counted), by, value, out, weight="_weight")
    if not by:
        return single_row(summary, median)
    names = [f"_m{i}" for i in range(len(by))]
    right = median.select(*[F.col(b).alias(n) for b, n in zip(by, names)], out)
    match = reduce(
        lambda a, c: a & c, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)]
    )
    return summary.join(right, match, "left").drop(*names)


def qa_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _summarise(scored, by, "qa")


def grounding_summary(
    scored: DataFrame, by: Sequence[str] = (), thresholds: Sequence[int] = THRESHOLDS
) -> DataFrame:
    return _summarise(scored, by, "grounding", thresholds)


def grounding_breakdown(scored: DataFrame, field: str) -> DataFrame:
    return scored.groupBy(records.field_or(scored, field).alias(field)).agg(
        F.count(F.lit(1)).alias("examples"),
        rate("within_element_bounds").alias("click_accuracy"),
        F.coalesce(F.avg("pixel_distance"), F.lit(0.0)).alias("mean_pixel_distance"),
    )


def action_summary(
    scored: DataFrame, by: Sequence[str] = (), thresholds: Sequence[int] = THRESHOLDS
) -> DataFrame:
    """Rates over all rows; click figures over click targets, where a missing value is a miss."""
    return _summarise(scored, by, "action", thresholds)


def action_name_accuracy(scored: DataFrame) -> DataFrame:
    known = "target_name" in scored.columns
    name = F.col("target_name") if known else F.get_json_object("target_action", "$.name")
    return scored.groupBy(name.alias("action")).agg(
        F.count(F.lit(1)).alias("examples"),
        rate("action_name_correct").alias("action_name_accuracy"),
    )


# ---- mixed evaluations ----------------------------------------------------------------------


def score_mixed_rows(df: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Score each task with its own rule; one wide table with typed columns."""
    qa = qa_score(df.where(F.col("task") == "qa"))
    grounding = grounding_score(df.where(F.col("task") == "grounding"), thresholds)
    action = action_score(df.where(F.col("task") == "action"))
    return qa.unionByName(grounding, allowMissingColumns=True).unionByName(
        action, allowMissingColumns=True
    )


MIXED_BASE = ("benchmark", "_category", "_focus")


def evaluation_groups(sums: DataFrame) -> DataFrame:
    """Repeat rows for the whole evaluation, the website category and the application focus."""

    def key(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    keys = F.array(
        key("all", F.lit("all")),
        key("website_category", F.col("_category")),
        key("application_focus", F.col("_focus")),
    )
    return sums.withColumn("_g", F.explode(keys)).withColumns(
        {"group_kind": F.col("_g.kind"), "group_value": F.col("_g.value")}
    ).drop("_g")


def score_mixed(scored: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Long metrics (group_kind, group_value, benchmark, task, metric, value) of a scored table.

    Rows are summed once per (benchmark, category, focus); only those sums are repeated for the
    three groupings.
    """
    focus = F.coalesce(records.optional(scored, "application_focused", "boolean"), F.lit(False))
    based = scored.withColumns(
        {
            "benchmark": records.field_or(scored, "benchmark"),
            "_category": records.field_or(scored, "website_category", "unclassified"),
            "_focus": F.when(focus, "application").otherwise("other"),
        }
    )
    by = ["group_kind", "group_value", "benchmark"]
    long = [
        to_long(
            _summarise(
                based.where(F.col("task") == task), by, task, thresholds, evaluation_groups, MIXED_BASE
            ),
            by, task,
        )
        for task in TASKS
    ]
    return reduce(DataFrame.unionByName, long)


SCORES = (
    "id", "task", "benchmark", "domain", "website_category", "application_focused", "label",
    "source_evaluation_label", "exact_match", "token_f1", "parse_success", "point_on_grid",
    "within_element_bounds", "pixel_distance", "action_parse_valid", "action_name_correct",
    "action_arguments_correct", "action_exact", "click_distance_px", "click_inside_bbox",
    "click_target", "boxed_target", "error_category",
)


def score_columns(scored: DataFrame) -> list[str]:
    """The columns that summaries read; texts and JSON are not among them."""
    within = [c for c in scored.columns if c.startswith("within_") and c.endswith("px")]
    return [c for c in SCORES if c in scored.columns] + within


def to_long(summary: DataFrame, by: Sequence[str], task: str) -> DataFrame:
    """Wide summary to one row per metric."""
    metrics = [c for c in summary.columns if c not in by]
    wide = summary.select(*by, *[F.col(m).cast("double") for m in metrics])
    return wide.unpivot(list(by), metrics, "metric", "value").select(
        *by, F.lit(task).alias("task"), "metric", "value"
    )


def macro_over_domain(scored: DataFrame) -> DataFrame:
    """Macro means over domains of the primary metrics, in one aggregation."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.when(F.col("task") == task, F.col(column).cast("double")).alias("v"),
            )
            for name, (task, column) in PRIMARY.items()
        ]
    )
    domain = records.field_or(scored, "domain").alias("domain")
    rows = scored.select(domain, F.explode(cells).alias("c")).select(
        "domain", "c.metric", F.col("c.v").alias("hit")
    )
    return macro_metric(rows, "hit", "domain", ["metric"])


def score_by_benchmark(df: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """QA and grounding summaries per benchmark, as long metrics."""
    known = df.withColumn("benchmark", records.field_or(df, "benchmark"))
    qa = qa_summary(qa_score(known.where(F.col("task") == "qa")), ["benchmark"])
    scored = grounding_score(known.where(F.col("task") == "grounding"), thresholds)
    # sums and the median both read the scores
    grounding = grounding_summary(cut(scored, *score_columns(scored)), ["benchmark"], thresholds)
    return to_long(qa, ["benchmark"], "qa").unionByName(
        to_long(grounding, ["benchmark"], "grounding")
    )


def representative_bucket(df: DataFrame) -> Column:
    result = F.coalesce("error_category", F.concat("task", F.lit("_correct")))
    return F.concat_ws("_", records.field_or(df, "benchmark"), result)


def first_answer_leaks(df: DataFrame, shown: Column) -> Column:
    return shown != F.btrim(blank_to(F.col("prediction"), ""))
