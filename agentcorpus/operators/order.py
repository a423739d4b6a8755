"""Diagnostic orders and choices of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.operators.align import CheckFailed, require_empty

# ---- fixed values: data-set sizes from smallest to largest -----------------------------------
SIZES = ("small", "medium", "large")
# ---------------------------------------------------------------------------------------------


def size_rank(size: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SIZES]), size).cast("int")


def qa_diagnostic_order(scored: DataFrame) -> list[Column]:
    return [F.col("exact_match"), F.lower("question_type"), F.col("id")]


def grounding_diagnostic_order(scored: DataFrame) -> list[Column]:
    priority = F.when(~F.col("parse_success"), 0).when(~F.col("within_element_bounds"), 1).otherwise(2)
    return [
        priority, F.coalesce("pixel_distance", F.lit(0.0)).desc(), F.col("domain"), F.col("id"),
    ]


def action_diagnostic_order(scored: DataFrame) -> list[Column]:
    # Sort keys are worked out anew in comparisons: the name is at hand in scored rows.
    known = "target_name" in scored.columns
    name = F.col("target_name") if known else F.get_json_object("target_action", "$.name")
    priority = (
        F.when((name == "click") & (F.col("click_inside_bbox") == F.lit(False)), 0)
        .when(~F.col("action_name_correct"), 1)
        .when(name == "click", 2)
        .otherwise(3)
    )
    return [priority, name, F.col("id")]


def diagnostic_rows(scored: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows: each partition sends at most that many to the final merge."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return scored.orderBy(*order).limit(limit)


SELECTION = (
    "click_inside_bbox_accuracy", "action_name_accuracy", "action_argument_accuracy",
)


def select_checkpoint(gates: DataFrame) -> DataFrame:
    """Best gate without regressions: lexicographic over three metrics, then the earliest step.

    Nulls rank below every number.  A non-finite metric, a step that occurs twice, and gates that
    all regressed are errors.
    """

    def metric(name):
        value = F.col(name).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(value.isNull(), F.lit(float("-inf"))).when(
            bad, F.raise_error(F.lit(f"non-finite {name}")).cast("double")
        ).otherwise(value)

    require_empty(duplicate_steps(gates), "steps occur twice")
    eligible = gates.where(~F.col("regressed"))
    if eligible.isEmpty():
        raise CheckFailed("no checkpoint without regressions")
    return eligible.orderBy(
        *[metric(name).desc() for name in SELECTION], F.col("step").asc()
    ).limit(1)


def duplicate_steps(gates: DataFrame) -> DataFrame:
    return gates.groupBy("step").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_candidate(registry: DataFrame) -> DataFrame:
    return registry.orderBy(
        size_rank(F.col("size")).desc(), F.col("step").desc(), F.col("seed").desc()
    ).limit(1)


def registry_order(registry: DataFrame) -> DataFrame:
    return registry.orderBy(size_rank(F.col("size")), "step", "seed")
