"""Scores, summaries, diagnostics and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import ORACLES, query, r6, rounded, sql_key, table
from agentcorpus.operators import order, sample, score
from agentcorpus.plans import dashboards, evaluation
from agentcorpus.session import cut


def _latest(spark, folder, label="latest"):
    return B.qa_predictions(spark, folder).where(F.col("label") == label)


_QA_CATEGORY = """CASE WHEN exact_match THEN NULL WHEN contains(question_type, 'ocr') OR
  contains(question_type, 'text') OR contains(question_type, 'read') THEN 'ocr'
  ELSE 'semantic_understanding' END"""


def stored_scores(scored):
    """Scores without their texts, written once: sums and medians both read them."""
    return cut(scored, *score.score_columns(scored))


@query(
    "qa_score",
    f"""WITH {B.QA_SCORED_SQL} SELECT id, label, exact_match, round(token_f1, 6) AS token_f1,
        {_QA_CATEGORY} AS error_category FROM s""",
)
def qa_score(spark, folder):
    scored = score.qa_score(B.qa_predictions(spark, folder))
    return scored.select(
        "id", "label", "exact_match", r6("token_f1").alias("token_f1"), "error_category"
    )


@query(
    "qa_summary",
    f"""WITH {B.QA_SCORED_SQL} SELECT label, question_type, count(*)::BIGINT AS examples,
        round(avg(exact_match::INT::DOUBLE), 6) AS answer_accuracy,
        round(avg(token_f1), 6) AS mean_token_f1 FROM s GROUP BY label, question_type""",
)
def qa_summary(spark, folder):
    scored = score.qa_score(B.qa_predictions(spark, folder))
    return rounded(score.qa_summary(scored, ["label", "question_type"]))


@query(
    "parse_grounding_predictions",
    f"""WITH {B.GROUNDING_SQL} SELECT id, CASE WHEN parse_success THEN px END AS px,
        CASE WHEN parse_success THEN py END AS py,
        CASE WHEN NOT parse_success THEN 'output_format' END AS parse_error FROM g""",
)
def parse_grounding_predictions(spark, folder):
    parsed = score.parse_grounding_predictions(B.grounding_predictions(spark, folder))
    return parsed.select(
        "id", F.get("parsed_point", F.lit(0)).alias("px"),
        F.get("parsed_point", F.lit(1)).alias("py"), "parse_error",
    )


@query(
    "grounding_score",
    f"""WITH {B.GROUNDING_SQL} SELECT id, parse_success, point_on_grid, within_element_bounds,
        round(pixel_distance, 4) AS pixel_distance,
        coalesce(pixel_distance <= 50, false) AS within_50px,
        CASE WHEN NOT parse_success THEN 'output_format'
          WHEN NOT within_element_bounds THEN 'spatial_grounding' END AS error_category FROM g""",
)
def grounding_score(spark, folder):
    scored = score.grounding_score(B.grounding_predictions(spark, folder))
    return scored.select(
        "id", "parse_success", "point_on_grid", "within_element_bounds",
        F.round("pixel_distance", 4).alias("pixel_distance"), "within_50px", "error_category",
    )


_GROUNDING_METRICS = """count(*)::BIGINT AS examples, round(avg(parse_success::INT::DOUBLE), 6)
  AS parse_rate, round(avg(point_on_grid::INT::DOUBLE), 6) AS point_on_grid_rate,
  round(avg(within_element_bounds::INT::DOUBLE), 6) AS click_accuracy,
  round(coalesce(avg(within_element_bounds::INT::DOUBLE) FILTER (parse_success), 0.0), 6)
    AS click_accuracy_given_parse,
  round(coalesce(avg(pixel_distance), 0.0), 6) AS mean_pixel_distance,
  round(avg(coalesce(pixel_distance <= 25, false)::INT::DOUBLE), 6) AS accuracy_within_25px,
  round(avg(coalesce(pixel_distance <= 50, false)::INT::DOUBLE), 6) AS accuracy_within_50px,
  round(avg(coalesce(pixel_distance <= 100, false)::INT::DOUBLE), 6) AS accuracy_within_100px,
  round(median(pixel_distance), 6) AS median_pixel_distance"""


@query(
    "grounding_summary",
    f"WITH {B.GROUNDING_SQL} SELECT benchmark, {_GROUNDING_METRICS} FROM g GROUP BY benchmark",
)
def grounding_summary(spark, folder):
    # Sums and the median both read the scores: store them once.
    scored = stored_scores(score.grounding_score(B.grounding_predictions(spark, folder)))
    return rounded(score.grounding_summary(scored, ["benchmark"]))


@query(
    "grounding_summary_all",
    f"WITH {B.GROUNDING_SQL} SELECT {_GROUNDING_METRICS} FROM g",
)
def grounding_summary_all(spark, folder):
    return rounded(
        score.grounding_summary(
            stored_scores(score.grounding_score(B.grounding_predictions(spark, folder)))
        )
    )


@query(
    "grounding_breakdown",
    f"""WITH {B.GROUNDING_SQL} SELECT element_type, count(*)::BIGINT AS examples,
        round(avg(within_element_bounds::INT::DOUBLE), 6) AS click_accuracy,
        round(coalesce(avg(pixel_distance), 0.0), 6) AS mean_pixel_distance
        FROM g GROUP BY element_type""",
)
def grounding_breakdown(spark, folder):
    scored = score.grounding_score(B.grounding_predictions(spark, folder))
    return rounded(score.grounding_breakdown(scored, "element_type"))


@query(
    "parse_action_predictions",
    f"""WITH {B.ACTIONS_SQL} SELECT coalesce(parse_error, 'valid') AS reason, target_name,
        count(*)::BIGINT AS n FROM a GROUP BY ALL""",
)
def parse_action_predictions(spark, folder):
    rows = B.action_predictions(spark, folder).withColumn(
        "target_name", F.get_json_object("target_action", "$.name")
    )
    return score.parse_error_summary(score.parse_action_predictions(rows), ["target_name"])


@query(
    "action_score",
    f"""WITH {B.ACTIONS_SQL} SELECT id, action_parse_valid, action_name_correct,
        action_arguments_correct, action_exact, round(click_distance_px, 4) AS click_distance_px,
        click_inside_bbox FROM a""",
)
def action_score(spark, folder):
    scored = score.action_score(B.action_predictions(spark, folder))
    return scored.select(
        "id", "action_parse_valid", "action_name_correct", "action_arguments_correct",
        "action_exact", F.round("click_distance_px", 4).alias("click_distance_px"),
        "click_inside_bbox",
    )


_ACTION_METRICS = """count(*)::BIGINT AS examples,
  round(avg(action_parse_valid::INT::DOUBLE), 6) AS json_parse_rate,
  round(avg(action_name_correct::INT::DOUBLE), 6) AS action_name_accuracy,
  round(avg(action_arguments_correct::INT::DOUBLE), 6) AS action_argument_accuracy,
  round(avg(action_exact::INT::DOUBLE), 6) AS exact_action_accuracy,
  count(*) FILTER (boxed)::BIGINT AS click_target_examples_with_bbox,
  round(avg(coalesce(click_inside_bbox, false)::INT::DOUBLE) FILTER (boxed), 6)
    AS click_inside_bbox_accuracy,
  count(click_distance_px)::BIGINT AS click_predictions_with_distance,
  round(avg(coalesce(click_distance_px <= 25, false)::INT::DOUBLE) FILTER (target_name = 'click'), 6)
    AS click_within_25px_accuracy,
  round(avg(coalesce(click_distance_px <= 50, false)::INT::DOUBLE) FILTER (target_name = 'click'), 6)
    AS click_within_50px_accuracy,
  round(avg(coalesce(click_distance_px <= 100, false)::INT::DOUBLE) FILTER (target_name = 'click'), 6)
    AS click_within_100px_accuracy,
  round(median(click_distance_px), 6) AS click_median_distance_px"""


@query(
    "action_summary",
    f"""WITH {B.ACTIONS_SQL} SELECT website_category, {_ACTION_METRICS} FROM a
        GROUP BY website_category""",
)
def action_summary(spark, folder):
    scored = stored_scores(score.action_score(B.action_predictions(spark, folder)))
    return rounded(score.action_summary(scored, ["website_category"]))


@query(
    "action_name_accuracy",
    f"""WITH {B.ACTIONS_SQL} SELECT target_name AS action, count(*)::BIGINT AS examples,
        round(avg(action_name_correct::INT::DOUBLE), 6) AS action_name_accuracy FROM a
        GROUP BY target_name""",
)
def action_name_accuracy(spark, folder):
    scored = score.action_score(B.action_predictions(spark, folder))
    return rounded(score.action_name_accuracy(scored))


def mixed_predictions(spark, folder):
    qa = _latest(spark, folder).drop("label")
    return qa.unionByName(
        B.grounding_predictions(spark, folder), allowMissingColumns=True
    ).unionByName(B.action_predictions(spark, folder), allowMissingColumns=True)


MIXED_SQL = f"""
{B.QA_SCORED_SQL}, {B.GROUNDING_SQL}, {B.ACTIONS_SQL},
ql AS (SELECT * FROM s WHERE label = 'latest')
"""


def _groups(view: str, columns: str) -> str:
    return (
        f"(SELECT 'all' AS group_kind, 'all' AS group_value, {columns} FROM {view} UNION ALL "
        f"SELECT 'website_category', website_category, {columns} FROM {view} UNION ALL "
        f"SELECT 'application_focus', CASE WHEN application_focused THEN 'application' "
        f"ELSE 'other' END, {columns} FROM {view})"
    )


def _unpivot(task: str, names: dict[str, str], source: str, benchmark: str) -> str:
    parts = [
        f"SELECT group_kind, group_value, {benchmark} AS benchmark, '{task}' AS task, "
        f"'{name}' AS metric, round(({rule})::DOUBLE, 6) AS value FROM {source} "
        "GROUP BY group_kind, group_value, 3"
        for name, rule in names.items()
    ]
    return " UNION ALL ".join(parts)


_QA_LONG = {
    "examples": "count(*)",
    "answer_accuracy": "avg(exact_match::INT::DOUBLE)",
    "mean_token_f1": "avg(token_f1)",
}


def _within(column: str, limit: int, only: str = "") -> str:
    return f"avg(coalesce({column} <= {limit}, false)::INT::DOUBLE) {only}"


_GROUNDING_LONG = {
    "examples": "count(*)",
    "parse_rate": "avg(parse_success::INT::DOUBLE)",
    "point_on_grid_rate": "avg(point_on_grid::INT::DOUBLE)",
    "click_accuracy": "avg(within_element_bounds::INT::DOUBLE)",
    "click_accuracy_given_parse": (
        "coalesce(avg(within_element_bounds::INT::DOUBLE) FILTER (parse_success), 0.0)"
    ),
    "mean_pixel_distance": "coalesce(avg(pixel_distance), 0.0)",
    **{f"accuracy_within_{t}px": _within("pixel_distance", t) for t in (25, 50, 100)},
    "median_pixel_distance": "median(pixel_distance)",
}
_CLICK = "FILTER (target_name = 'click')"
_ACTION_LONG = {
    "examples": "count(*)",
    "json_parse_rate": "avg(action_parse_valid::INT::DOUBLE)",
    "action_name_accuracy": "avg(action_name_correct::INT::DOUBLE)",
    "action_argument_accuracy": "avg(action_arguments_correct::INT::DOUBLE)",
    "exact_action_accuracy": "avg(action_exact::INT::DOUBLE)",
    "click_target_examples_with_bbox": "count(*) FILTER (boxed)",
    "click_inside_bbox_accuracy": (
        "avg(coalesce(click_inside_bbox, false)::INT::DOUBLE) FILTER (boxed)"
    ),
    "click_predictions_with_distance": "count(click_distance_px)",
    **{
        f"click_within_{t}px_accuracy": _within("click_distance_px", t, _CLICK)
        for t in (25, 50, 100)
    },
    "click_median_distance_px": "median(click_distance_px)",
}


@query(
    "score_mixed",
    f"""WITH {MIXED_SQL}, mq AS {_groups('ql', 'benchmark, exact_match, token_f1')},
    mg AS {_groups('g', 'benchmark, parse_success, point_on_grid, within_element_bounds, pixel_distance')},
    ma AS {_groups('a', 'target_name, boxed, action_parse_valid, action_name_correct, action_arguments_correct, action_exact, click_distance_px, click_inside_bbox')}
    {_unpivot('qa', _QA_LONG, 'mq', 'benchmark')} UNION ALL
    {_unpivot('grounding', _GROUNDING_LONG, 'mg', 'benchmark')} UNION ALL
    {_unpivot('action', _ACTION_LONG, 'ma', "'web'")}""",
)
def score_mixed(spark, folder):
    scored = stored_scores(score.score_mixed_rows(mixed_predictions(spark, folder)))
    return rounded(score.score_mixed(scored))


@query("merge_and_score", ORACLES["score_mixed"])
def merge_and_score(spark, folder):
    """The same rows as predictions of four shards: checked, merged, scored and summarised."""
    key = F.concat_ws("-", "task", "id")
    rows = mixed_predictions(spark, folder).withColumn("id", key)
    index = F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")
    name = F.concat(F.lit("shard-"), index.cast("string"))
    predictions = rows.withColumns({"evaluation_label": name, "run_signature": name})
    expected = rows.select("id", F.col("id").alias("order_key"))
    shards = predictions.select("evaluation_label").distinct().select(
        F.lit("mixed").alias("label"),
        F.substring("evaluation_label", 7, 9).cast("int").alias("shard_index"),
        F.lit(4).alias("num_shards"), F.lit("base").alias("model"), F.lit("r1").alias("model_revision"),
        F.concat(F.lit("/mnt/"), "evaluation_label", F.lit("/adapter")).alias("adapter"),
        F.lit("h").alias("adapter_sha256"), F.array(F.lit("/data/eval.jsonl")).alias("manifests"),
    )
    found = evaluation.merge_and_score(expected, predictions, shards, "merged", "sig")
    return rounded(found["metrics"])


@query(
    "macro_over_domain",
    f"""WITH {MIXED_SQL}, x AS (SELECT 'qa_answer_accuracy' AS metric, domain, exact_match AS hit FROM ql
      UNION ALL SELECT 'grounding_click_accuracy', domain, within_element_bounds FROM g
      UNION ALL SELECT 'action_name_accuracy', domain, action_name_correct FROM a
      UNION ALL SELECT 'action_exact_accuracy', domain, action_exact FROM a),
    m AS (SELECT metric, domain, count(*) AS n, avg(hit::INT::DOUBLE) AS mean, sum(hit::INT) AS s
      FROM x GROUP BY ALL)
    SELECT metric, sum(n)::BIGINT AS examples, count(*)::BIGINT AS groups,
      round(sum(s)::DOUBLE / sum(n), 6) AS micro, round(avg(mean), 6) AS macro FROM m GROUP BY metric""",
)
def macro_over_domain(spark, folder):
    scored = score.score_mixed_rows(mixed_predictions(spark, folder))
    return rounded(score.macro_over_domain(scored))


@query(
    "score_by_benchmark",
    f"""WITH {MIXED_SQL}, mq AS (SELECT 'all' AS group_kind, 'all' AS group_value, * FROM ql),
    mg AS (SELECT 'all' AS group_kind, 'all' AS group_value, * FROM g)
    SELECT benchmark, task, metric, value FROM ({_unpivot('qa', _QA_LONG, 'mq', 'benchmark')} UNION ALL
    {_unpivot('grounding', _GROUNDING_LONG, 'mg', 'benchmark')})""",
)
def score_by_benchmark(spark, folder):
    return rounded(score.score_by_benchmark(mixed_predictions(spark, folder)))


_ACTION_CATEGORY = """CASE WHEN NOT action_parse_valid THEN 'output_format'
  WHEN NOT action_name_correct THEN 'semantic_action'
  WHEN target_name = 'click' AND boxed AND NOT coalesce(click_inside_bbox, false)
    THEN 'spatial_grounding'
  WHEN NOT action_arguments_correct THEN 'action_arguments' ELSE 'correct' END"""


@query(
    "action_error_category",
    f"""WITH {B.ACTIONS_SQL} SELECT {_ACTION_CATEGORY} AS error_category, count(*)::BIGINT AS n
        FROM a GROUP BY 1""",
)
def action_error_category(spark, folder):
    scored = score.action_score(B.action_predictions(spark, folder))
    return scored.groupBy("error_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "representative_errors",
    f"""WITH {B.ACTIONS_SQL}, c AS (SELECT id, {_ACTION_CATEGORY} AS bucket FROM a)
    SELECT id, bucket FROM c QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY
      {sql_key('id', 'bucket')}, id) <= CASE WHEN bucket = 'correct' THEN 10 ELSE 25 END""",
)
def representative_errors(spark, folder):
    scored = score.action_score(B.action_predictions(spark, folder))
    return sample.representative_errors(scored, F.col("error_category"), 25).select("id", "bucket")


@query(
    "representative_failures",
    f"""WITH {MIXED_SQL}, z AS (SELECT id, 'web_' || coalesce({_QA_CATEGORY}, 'qa_correct') AS bucket
        FROM ql UNION ALL SELECT id, benchmark || '_' || CASE WHEN NOT parse_success THEN 'output_format'
          WHEN NOT within_element_bounds THEN 'spatial_grounding' ELSE 'grounding_correct' END FROM g)
    SELECT id, bucket FROM z QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY
      {sql_key('id', 'bucket')}, id) <= CASE WHEN suffix(bucket, 'correct') THEN 10 ELSE 12 END""",
)
def representative_failures(spark, folder):
    qa = score.qa_score(_latest(spark, folder)).select("id", "benchmark", "task", "error_category")
    ground = score.grounding_score(B.grounding_predictions(spark, folder)).select(
        "id", "benchmark", "task", "error_category"
    )
    rows = qa.unionByName(ground)
    return sample.representative_errors(rows, score.representative_bucket(rows), 12).select(
        "id", "bucket"
    )


# ---- diagnostic orders ------------------------------------------------------------------------


@query(
    "qa_diagnostic_order",
    f"""WITH {B.QA_SCORED_SQL} SELECT id, exact_match, question_type FROM s WHERE label = 'latest'
        ORDER BY exact_match, lower(question_type), id LIMIT 100""",
)
def qa_diagnostic_order(spark, folder):
    scored = score.qa_score(_latest(spark, folder))
    return order.diagnostic_rows(scored, order.qa_diagnostic_order(scored), 100).select(
        "id", "exact_match", "question_type"
    )


@query(
    "grounding_diagnostic_order",
    f"""WITH {B.GROUNDING_SQL} SELECT id, within_element_bounds, domain FROM g ORDER BY
        CASE WHEN NOT parse_success THEN 0 WHEN NOT within_element_bounds THEN 1 ELSE 2 END,
        coalesce(pixel_distance, 0) DESC, domain, id LIMIT 64""",
)
def grounding_diagnostic_order(spark, folder):
    scored = score.grounding_score(B.grounding_predictions(spark, folder))
    return order.diagnostic_rows(scored, order.grounding_diagnostic_order(scored), 64).select(
        "id", "within_element_bounds", "domain"
    )


@query(
    "action_diagnostic_order",
    f"""WITH {B.ACTIONS_SQL} SELECT id, target_name FROM a ORDER BY
        CASE WHEN target_name = 'click' AND click_inside_bbox = false THEN 0
          WHEN NOT action_name_correct THEN 1 WHEN target_name = 'click' THEN 2 ELSE 3 END,
        target_name, id LIMIT 64""",
)
def action_diagnostic_order(spark, folder):
    scored = score.action_score(B.action_predictions(spark, folder))
    top = order.diagnostic_rows(scored, order.action_diagnostic_order(scored), 64)
    return top.select("id", F.get_json_object("target_action", "$.name").alias("target_name"))


# ---- dashboards -------------------------------------------------------------------------------


@query(
    "qa_dashboard",
    f"""WITH q AS (SELECT * REPLACE (trim(regexp_replace(prediction, '(?s)\\n(user|assistant)\\n.*$', ''),
          chr(32) || chr(10)) AS prediction), prediction AS raw FROM ({B.QA_SQL})),
    {B.QA_SCORED_TAIL}
    SELECT label, count(*)::BIGINT AS examples, round(avg(exact_match::INT::DOUBLE), 6)
      AS exact_accuracy, round(avg(token_f1), 6) AS mean_token_f1,
      count(*) FILTER (prediction <> trim(raw, chr(32) || chr(10)))::BIGINT AS turn_leak_examples
    FROM s GROUP BY label""",
)
def qa_dashboard(spark, folder):
    return rounded(dashboards.qa_dashboard(B.qa_predictions(spark, folder), B.LABELS)["metrics"])


@query(
    "qa_dashboard_records",
    f"""WITH q AS (SELECT * REPLACE (trim(regexp_replace(prediction, '(?s)\\n(user|assistant)\\n.*$', ''),
          chr(32) || chr(10)) AS prediction), prediction AS raw FROM ({B.QA_SQL})),
    {B.QA_SCORED_TAIL}, p AS (SELECT id, max(CASE WHEN label = 'baseline' THEN prediction END) AS baseline,
      max(CASE WHEN label = 'latest' THEN prediction END) AS latest FROM ({B.QA_SQL}) GROUP BY id)
    SELECT s.id, row_number() OVER (ORDER BY exact_match, lower(question_type), s.id)::BIGINT
      AS display_rank, sha256(p.baseline) AS baseline, sha256(p.latest) AS latest
    FROM s JOIN p ON s.id = p.id WHERE label = 'latest'""",
)
def qa_dashboard_records(spark, folder):
    rows = dashboards.qa_dashboard(B.qa_predictions(spark, folder), B.LABELS)["records"]
    return rows.select(
        "id", "display_rank", F.sha2("baseline", 256).alias("baseline"),
        F.sha2("latest", 256).alias("latest"),
    )


@query(
    "grounding_dashboard",
    f"""WITH {B.GROUNDING_SQL} SELECT 'latest' AS label, count(*)::BIGINT AS examples,
        round(avg(parse_success::INT::DOUBLE), 6) AS parse_rate,
        round(avg(within_element_bounds::INT::DOUBLE), 6) AS click_accuracy,
        round(avg(pixel_distance), 6) AS mean_pixel_distance,
        round(avg(coalesce(pixel_distance <= 25, false)::INT::DOUBLE), 6) AS accuracy_within_25px,
        round(avg(coalesce(pixel_distance <= 50, false)::INT::DOUBLE), 6) AS accuracy_within_50px,
        round(avg(coalesce(pixel_distance <= 100, false)::INT::DOUBLE), 6) AS accuracy_within_100px,
        round(median(pixel_distance), 6) AS median_pixel_distance FROM g""",
)
def grounding_dashboard(spark, folder):
    rows = B.grounding_predictions(spark, folder).withColumn("label", F.lit("latest"))
    return rounded(dashboards.grounding_dashboard(rows)["metrics"])


@query(
    "action_dashboard",
    f"""WITH {B.ACTIONS_SQL}, t AS (SELECT * FROM a ORDER BY
        CASE WHEN target_name = 'click' AND click_inside_bbox = false THEN 0
          WHEN NOT action_name_correct THEN 1 WHEN target_name = 'click' THEN 2 ELSE 3 END,
        target_name, id LIMIT 64)
    SELECT (SELECT count(*) FROM a)::BIGINT AS scored_examples, count(*)::BIGINT AS display_examples,
      count(DISTINCT image)::BIGINT AS unique_screenshots FROM t""",
)
def action_dashboard(spark, folder):
    rows = B.action_predictions(spark, folder).withColumn("label", F.lit("latest"))
    return dashboards.action_dashboard(rows, "latest", 64)["meta"]


@query(
    "parse_policy_outputs",
    """SELECT event_type AS variant_id, count(*)::BIGINT AS steps,
       count(*) FILTER (bad)::BIGINT AS parse_errors, round(avg(bad::INT::DOUBLE), 6)
         AS parse_error_rate
       FROM (SELECT event_type, CASE event_type WHEN 'click' THEN value > 20 WHEN 'view' THEN value > 20
           OR (value * 5)::INT = 0 WHEN 'purchase' THEN value < 2 WHEN 'signup' THEN false
           ELSE true END AS bad FROM events) GROUP BY event_type""",
)
def parse_policy_outputs(spark, folder):
    events = table(spark, folder, "events")
    value, kind = F.col("value"), F.col("event_type")
    share = F.concat(F.when(value > 20, "1.5").otherwise("0.5"))
    amount = F.when(value > 20, "1.5").when(F.rint(value * 5).cast("int") == 0, "0").otherwise("0.25")
    output = (
        F.when(kind == "click", F.concat(F.lit('{"action":"click","x":'), share, F.lit(',"y":1}')))
        .when(
            kind == "view",
            F.concat(F.lit('{"action":"scroll","direction":"up","amount":'), amount, F.lit("}")),
        )
        .when(
            kind == "purchase",
            F.concat(F.lit('{"action":"type","text":"'), F.when(value < 2, "").otherwise("x"), F.lit('"}')),
        )
        .when(kind == "signup", F.lit('{"action":"done","result":""}'))
        .when(value < 5, F.lit('{"action":"click","x":true,"y":0.5}'))
        .when(value < 10, F.lit('{"action":"go_back","x":1}'))
        .otherwise(F.lit('{"action":"go_back"} and more'))
    )
    steps = events.select(kind.alias("variant_id"), output.alias("raw_policy_output"))
    return rounded(
        score.parse_error_rate(score.parse_policy_outputs(steps), ["variant_id"])
    )
