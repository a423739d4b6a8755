"""Dashboard tables from aligned predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions.text import first_answer, strip
from agentcorpus.operators import align, order, ranking, score
from agentcorpus.operators.rows import single_row
from agentcorpus.session import cut

DISPLAY = ("id", "image", "domain", "question", "answer")


def qa_dashboard(
    predictions: DataFrame, labels: Sequence[str], latest: str = "latest", limit: int | None = None
) -> dict[str, DataFrame]:
    """Metrics per label on the text before any continued chat, issues, and the displayed rows.

    ``predictions`` is long: one row per (label, id).
    """
    shown = predictions.withColumn("raw_prediction", F.coalesce("prediction", F.lit(""))).withColumn(
        "prediction", first_answer(F.col("raw_prediction"))
    )
    scored = score.qa_score(shown).withColumn(
        "leaked_turn", F.col("prediction") != strip(F.col("raw_prediction"))
    )
    metrics = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("examples"),
        score.rate("exact_match").alias("exact_accuracy"),
        score.rate("token_f1").alias("mean_token_f1"),
        F.count_if("leaked_turn").alias("turn_leak_examples"),
    )
    current = scored.where(F.col("label") == latest)
    displayed = ranking.displayed(current, order.qa_diagnostic_order(current), limit, "display_rank")
    others = align.align_predictions(predictions, labels)
    return {
        "metrics": metrics,
        "issues": align.alignment_issues(predictions, labels),
        "question_types": current.groupBy("question_type").agg(F.count(F.lit(1)).alias("n")),
        "records": displayed.drop("prediction").join(others, "id"),
    }


def grounding_dashboard(
    predictions: DataFrame, latest: str = "latest", limit: int | None = None
) -> dict[str, DataFrame]:
    scored = score.grounding_score(predictions)
    kept = cut(scored, *score.score_columns(scored))  # sums, medians and means all read the scores
    summary = score.grounding_summary(kept, ["label"]).drop(
        "point_on_grid_rate", "click_accuracy_given_parse", "mean_pixel_distance"
    )
    # The dashboard leaves an undefined mean empty where the summary writes zero.
    means = kept.groupBy("label").agg(F.avg("pixel_distance").alias("mean_pixel_distance"))
    current = scored.where(F.col("label") == latest)
    rows = ranking.displayed(
        current, order.grounding_diagnostic_order(current), limit, "display_rank"
    )
    return {
        "metrics": summary.join(means, "label"),
        "records": rows,
    }


def action_dashboard(
    predictions: DataFrame, latest: str = "latest", limit: int = 64
) -> dict[str, DataFrame]:
    scored = score.action_score(predictions)
    current = scored.where(F.col("label") == latest)
    displayed = order.diagnostic_rows(current, order.action_diagnostic_order(current), limit)
    # scoring keeps every row, so they are counted before it
    total = predictions.where(F.col("label") == latest).agg(F.count(F.lit(1)).alias("scored_examples"))
    shown = displayed.agg(
        F.count(F.lit(1)).alias("display_examples"),
        F.count_distinct("image").alias("unique_screenshots"),
    )
    return {
        "metrics": score.action_summary(scored, ["label"]),
        "meta": single_row(total, shown),
        "records": displayed,
        "target_action_counts": current.groupBy(
            F.get_json_object("target_action", "$.name").alias("action")
        ).agg(F.count(F.lit(1)).alias("n")),
    }


def combined_dashboard(**parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of the task dashboards under ``task_table`` names, ready for ``write_payload``."""
    return {
        f"{task}_{name}": df for task, tables in parts.items() for name, df in tables.items()
    }
