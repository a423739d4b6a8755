"""The given tables in the roles the operators expect, and the same views in SQL.

Each ``*_SQL`` text is a common table expression body that names the columns of its DataFrame twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus.catalogue.base import sql_mod, table
from agentcorpus.functions import hashing, web
from agentcorpus.session import spread

SEED = 53
SHARES = {"train": 70, "domain_balanced": 15, "distribution_shift": 15}
IID_PERCENT = 20

# ---- pages: one record per url ----------------------------------------------------------------

RULES = (("*.example.org", "service_application"), ("utm_source=feed", "transactional_application"))


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    url = F.col("url")
    task = F.when(F.contains(url, F.lit("?")), "qa").when(
        F.contains(url, F.lit("#")), "grounding"
    ).otherwise("action")
    name = F.when(url.endswith("/"), "click").when(url.endswith(".html"), "scroll").otherwise("go_back")
    number = F.regexp_extract(url, "/([0-9]+)", 1)
    return pages.select(
        F.col("page_id").cast("string").alias("id"),
        "url",
        web.host_domain(url).alias("domain"),
        F.lit("").alias("website"),
        task.alias("task"),
        F.regexp_extract(url, "^([a-z]+):", 1).alias("source"),
        F.when(number != "", F.concat(F.lit("images/"), number, F.lit(".jpg"))).alias("image"),
        F.when(task == "action", F.concat(F.lit('{"name":"'), name, F.lit('"}'))).alias(
            "target_action"
        ),
    )


HOST_SQL = (
    "regexp_replace(regexp_extract(lower(url), "
    "'^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1), '^www\\.', '')"
)
_NUMBER_SQL = "regexp_extract(url, '/([0-9]+)', 1)"
PAGES_SQL = f"""
SELECT page_id::VARCHAR AS id, url, {HOST_SQL} AS domain, '' AS website,
  CASE WHEN contains(url, '?') THEN 'qa' WHEN contains(url, '#') THEN 'grounding'
       ELSE 'action' END AS task,
  regexp_extract(url, '^([a-z]+):', 1) AS source,
  CASE WHEN {_NUMBER_SQL} <> '' THEN 'images/' || {_NUMBER_SQL} || '.jpg' END AS image,
  CASE WHEN contains(url, '?') OR contains(url, '#') THEN NULL
       WHEN suffix(url, '/') THEN 'click' WHEN suffix(url, '.html') THEN 'scroll'
       ELSE 'go_back' END AS action
FROM pages
"""


def _classify_sql() -> str:
    tokens = (
        "string_split(translate(lower(domain || ' ' || domain || ' ' || url), '/-', '..'), '.')"
    )

    def first(words):
        listed = ", ".join(f"'{w}'" for w in words)
        return f"list_min(list_intersect({tokens}, [{listed}]))"

    category, confidence, rule = [], [], []
    category.append("WHEN suffix(domain, '.example.org') THEN 'service_application'")
    category.append("WHEN contains(lower(url), 'utm_source=feed') THEN 'transactional_application'")
    confidence.append(
        "WHEN suffix(domain, '.example.org') OR contains(lower(url), 'utm_source=feed') "
        "THEN 'manual'"
    )
    rule.append("WHEN suffix(domain, '.example.org') THEN 'override:0:*.example.org'")
    rule.append("WHEN contains(lower(url), 'utm_source=feed') THEN 'override:1:utm_source=feed'")
    for name, words in web.VOCABULARIES:
        category.append(f"WHEN {first(words)} IS NOT NULL THEN '{name}'")
        confidence.append(f"WHEN {first(words)} IS NOT NULL THEN 'heuristic'")
        rule.append(f"WHEN {first(words)} IS NOT NULL THEN 'url-token:' || {first(words)}")
    return (
        f"CASE {' '.join(category)} ELSE 'general_web' END AS website_category, "
        f"CASE {' '.join(confidence)} ELSE 'unknown' END AS website_category_confidence, "
        f"CASE {' '.join(rule)} ELSE 'fallback' END AS website_category_rule"
    )


APPLICATIONS_SQL = ", ".join(f"'{c}'" for c in web.APPLICATION_CATEGORIES)
ANNOTATED_SQL = f"""
SELECT *, domain AS hostname, domain AS website_surface, {_classify_sql()} FROM ({PAGES_SQL})
"""

# ---- documents: one record per text; exact copies share an image and so a unit ----------------


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    n = F.col("n_chars")
    task = F.when(n % 3 == 0, "qa").when(n % 3 == 1, "grounding").otherwise("action")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("order_key"),
        F.when(n % 11 == 0, "unknown").otherwise(F.col("source")).alias("domain"),
        F.col("source"),
        F.col("lang").alias("website_category"),
        (F.col("lang") == "en").alias("application_focused"),
        task.alias("task"),
        F.concat(F.lit("images/"), F.substring(F.sha2("text", 256), 1, 24), F.lit(".jpg")).alias(
            "image"
        ),
        F.when(
            task == "action", F.concat(F.lit('{"name":"'), F.col("lang"), F.lit('"}'))
        ).alias("target_action"),
        F.col("lang").alias("question_type"),
        n.alias("n_chars"),
    )


_DOC_TASK = "CASE n_chars % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'grounding' ELSE 'action' END"
DOCUMENTS_SQL = f"""
SELECT doc_id::VARCHAR AS id, doc_id AS order_key,
  CASE WHEN n_chars % 11 = 0 THEN 'unknown' ELSE source END AS domain, source,
  lang AS website_category, lang = 'en' AS application_focused, {_DOC_TASK} AS task,
  'images/' || substr(sha256(text), 1, 24) || '.jpg' AS image,
  CASE WHEN {_DOC_TASK} = 'action' THEN lang END AS action, lang AS question_type, n_chars,
  'image:images/' || substr(sha256(text), 1, 24) || '.jpg' AS unit
FROM documents
"""

# ---- events: one record per event; a user's day is the trajectory -----------------------------


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.date_format("ts", "yyyyMMdd")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("trajectory_id"),
        F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")).alias(
            "domain"
        ),
        F.when(F.col("value") < 5, "qa").when(F.col("value") < 12, "grounding").otherwise(
            "action"
        ).alias("task"),
        F.when(k % 10 == 0, "distribution_shift").otherwise("training").alias("source_role"),
        F.concat(F.lit("trajectory:"), F.concat_ws("-", F.col("user_id").cast("string"), day)).alias(
            "unit"
        ),
    )


EVENTS_SQL = """
SELECT event_id::VARCHAR AS id, user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS trajectory_id,
  CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS domain,
  CASE WHEN value < 5 THEN 'qa' WHEN value < 12 THEN 'grounding' ELSE 'action' END AS task,
  CASE WHEN json_extract_string(props, '$.k')::INT % 10 = 0 THEN 'distribution_shift'
       ELSE 'training' END AS source_role,
  'trajectory:' || user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS unit
FROM events
"""


def partition_sql(domain: str) -> str:
    bucket = sql_mod(100, "'exp005-domain'", f"'{SEED}'", domain)
    return (
        f"CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 85 THEN 'domain_balanced' "
        "ELSE 'distribution_shift' END"
    )


DESTINATIONS_SQL = f"""
r AS ({EVENTS_SQL}),
u AS (SELECT unit, count(DISTINCT domain) AS unit_domains,
        max(domain = 'unknown') AS has_unknown,
        count(DISTINCT CASE WHEN domain <> 'unknown' THEN {partition_sql('domain')} END) AS parts,
        min(CASE WHEN domain <> 'unknown' THEN {partition_sql('domain')} END) AS part
      FROM r GROUP BY unit),
a AS (SELECT r.*, (u.has_unknown OR u.parts > 1) AS cross_partition,
        CASE WHEN u.has_unknown OR u.parts > 1 THEN NULL
             WHEN source_role = 'distribution_shift'
               THEN CASE WHEN part = 'distribution_shift' THEN part END
             WHEN part = 'domain_balanced' THEN part
             WHEN part = 'train' THEN CASE WHEN
               {sql_mod(100, "'exp005-iid'", f"'{SEED}'", 'unit')} < {IID_PERCENT}
               THEN 'iid' ELSE 'train' END
        END AS destination
      FROM r JOIN u USING (unit))
"""

# ---- conversations: steps of trajectories, and question answering predictions -----------------


def conversation_steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("trajectory_id"),
        F.col("turn").alias("step_index"),
        F.col("role").alias("action"),
        F.col("text").alias("thought"),
    )


def _qa_prediction(label: str):
    text, kind = F.col("text"), F.col(f"_{label}")
    return (
        F.when(kind == 0, F.concat(F.lit("The "), text, F.lit("!")))
        .when(kind == 1, F.substr(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .when(kind == 2, F.concat(text, F.lit("\nuser\nmore")))
        .otherwise("")
    )


LABELS = ("baseline", "latest")


def qa_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Long table (label, id, answer, prediction); each label answers another share correctly."""
    turns = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    identifier = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    keyed = turns.withColumns(
        {
            "id": identifier,
            **{f"_{name}": hashing.stable_mod(4, name, identifier) for name in LABELS},
        }
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("label"), _qa_prediction(n).alias("prediction")) for n in LABELS]
    )
    question_type = F.when(F.col("role") == "user", "reading").otherwise(F.col("role"))
    return keyed.select(
        "id",
        F.lit("qa").alias("task"),
        F.lit("web").alias("benchmark"),
        question_type.alias("question_type"),
        F.concat(F.lit("site"), F.col("turn").cast("string")).alias("domain"),
        F.col("role").alias("website_category"),
        (F.col("role") == "user").alias("application_focused"),
        F.concat(F.lit("images/qa/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.col("text").alias("question"),
        F.col("text").alias("answer"),
        F.explode(cells).alias("_c"),
    ).select("*", "_c.label", "_c.prediction").drop("_c")


_QA_ID = "conv_id::VARCHAR || '-' || turn::VARCHAR"
QA_SQL = f"""
SELECT id, 'qa' AS task, 'web' AS benchmark,
  CASE WHEN role = 'user' THEN 'reading' ELSE role END AS question_type,
  'site' || turn::VARCHAR AS domain, role AS website_category, role = 'user' AS application_focused,
  'images/qa/' || conv_id::VARCHAR || '.jpg' AS image, text AS question, text AS answer, label,
  CASE {sql_mod(4, 'label', 'id')} WHEN 0 THEN 'The ' || text || '!'
    WHEN 1 THEN substr(text, 1, (length(text) // 2)::BIGINT)
    WHEN 2 THEN text || chr(10) || 'user' || chr(10) || 'more' ELSE '' END AS prediction
FROM (SELECT *, {_QA_ID} AS id FROM conversations),
     (SELECT unnest(['baseline', 'latest']) AS label)
"""

TOKENS_SQL = (
    "list_filter(regexp_split_to_array(regexp_replace(lower({0}), "
    "'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"
)


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.format(text)


QA_SCORED_TAIL = f"""
t AS (SELECT *, {tokens_sql('prediction')} AS p, {tokens_sql('answer')} AS e FROM q),
c AS (SELECT id, label, sum(least(np, ne)) AS common FROM (
        SELECT id, label, tok, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS ne
        FROM (SELECT id, label, unnest(p) AS tok, 0 AS side FROM t
              UNION ALL SELECT id, label, unnest(e) AS tok, 1 AS side FROM t)
        GROUP BY id, label, tok) GROUP BY id, label),
s AS (SELECT t.*, array_to_string(p, ' ') = array_to_string(e, ' ') AS exact_match,
        CASE WHEN len(p) + len(e) = 0 THEN 1.0
             ELSE 2.0 * coalesce(common, 0) / (len(p) + len(e)) END::DOUBLE AS token_f1
      FROM t LEFT JOIN c USING (id, label))
"""

QA_SCORED_SQL = f"q AS ({QA_SQL}), {QA_SCORED_TAIL}"

# ---- lineitem: grounding and action predictions -----------------------------------------------


def _line_id():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    keys = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *[column.cast("string") for column in (*keys, cents)])


_LINE_ID = (
    "l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' "
    "|| l_suppkey::VARCHAR || '-' || round(l_extendedprice * 100)::BIGINT::VARCHAR"
)


def grounding_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return grounding_predictions_of(
        spread(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey")
    )


def grounding_predictions_of(line: DataFrame) -> DataFrame:
    x = F.col("l_quantity") * 10
    y = (F.col("l_partkey") % 900).cast("double")
    box = F.array(x, y, x + 40 + F.col("l_discount") * 1000, y + 30 + F.col("l_tax") * 1000)
    px = (F.col("l_quantity") * 10 + F.col("l_linenumber") * 12).cast("int").cast("string")
    py = (F.col("l_partkey") % 900 + F.col("l_suppkey") % 60).cast("int").cast("string")
    flag = F.col("l_returnflag")
    prediction = (
        F.when(flag == "A", F.concat(
            F.lit('[{"point_2d":['), px, F.lit(","), py, F.lit('],"label":"item"}]')))
        .when(flag == "N", F.concat(F.lit("point: ["), px, F.lit(", "), py, F.lit("]")))
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("at ("), px, F.lit(", "), py, F.lit(")")))
        .otherwise("no answer")
    )
    return line.select(
        _line_id().alias("id"),
        F.lit("grounding").alias("task"),
        F.when(F.col("l_linestatus") == "O", "web").otherwise("external").alias("benchmark"),
        F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("domain"),
        flag.alias("website_category"),
        (F.col("l_linestatus") == "O").alias("application_focused"),
        flag.alias("element_type"),
        F.col("l_linestatus").alias("data_source"),
        box.alias("bbox_normalized"),
        F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2).alias("target_point_normalized"),
        F.lit(1280).alias("image_width"),
        F.lit(720).alias("image_height"),
        prediction.alias("prediction"),
    )


GROUNDING_SQL = f"""
g0 AS (SELECT {_LINE_ID} AS id,
  CASE WHEN l_linestatus = 'O' THEN 'web' ELSE 'external' END AS benchmark,
  'supplier' || l_suppkey::VARCHAR AS domain, l_returnflag AS website_category,
  l_linestatus = 'O' AS application_focused,
  l_returnflag AS element_type, l_linestatus AS data_source,
  l_quantity * 10 AS x1, (l_partkey % 900)::DOUBLE AS y1,
  l_quantity * 10 + 40 + l_discount * 1000 AS x2,
  (l_partkey % 900)::DOUBLE + 30 + l_tax * 1000 AS y2,
  (l_returnflag IN ('A', 'N') OR l_linestatus = 'O') AS parse_success,
  (l_quantity * 10 + l_linenumber * 12)::DOUBLE AS px,
  (l_partkey % 900 + l_suppkey % 60)::DOUBLE AS py
  FROM lineitem),
g AS (SELECT *,
  parse_success AND px BETWEEN 0 AND 1000 AND py BETWEEN 0 AND 1000 AS point_on_grid,
  parse_success AND px BETWEEN 0 AND 1000 AND py BETWEEN 0 AND 1000
    AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AS within_element_bounds,
  CASE WHEN parse_success THEN
    sqrt(pow((px - (x1 + x2) / 2) / 1000 * 1280, 2) + pow((py - (y1 + y2) / 2) / 1000 * 720, 2))
  END AS pixel_distance FROM g0)
"""


def action_predictions(spark: SparkSession, folder: str) -> DataFrame:
    line = spread(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey")
    x = (F.col("l_quantity") * 2).cast("int")
    y = (F.col("l_partkey") % 101).cast("int")
    px = F.least(x + (F.col("l_suppkey") % 4).cast("int"), F.lit(100))
    dy = (F.col("l_suppkey") % 30).cast("int")
    pdy = dy + (F.col("l_partkey") % 15).cast("int")

    def body(name, fields):
        parts = [F.lit('{"name":"' + name + '"')]
        for key, value in fields.items():
            parts += [F.lit(f',"{key}":'), value.cast("string")]
        return F.concat(*parts, F.lit("}"))

    def action(ax, ady, text):
        number = F.col("l_linenumber")
        return (
            F.when(number <= 3, body("click", {"x": ax, "y": y}))
            .when(number == 4, body("scroll", {"delta_x": F.lit(0), "delta_y": ady}))
            .when(
                number == 5,
                body("scroll_at", {"x": ax, "y": y, "delta_x": F.lit(0), "delta_y": ady}),
            )
            .when(
                number == 6,
                body("mouse_drag_and_drop", {"from_x": ax, "from_y": y, "to_x": x, "to_y": y}),
            )
            .otherwise(
                F.concat(F.lit('{"name":"keyboard_type","text":"'), text, F.lit('"}'))
            )
        )

    target = action(x, dy, F.col("l_linestatus"))
    guess = action(px, pdy, F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).otherwise("?"))
    prediction = (
        F.when(F.col("l_tax") >= 0.08, F.lit("not json"))
        .when(F.col("l_tax") >= 0.07, F.lit('{"thought":"t","action":{"name":"go_back"}}'))
        .when(F.col("l_tax") >= 0.06, F.lit('{"thought":"t","action":{"name":"click","x":true,"y":1}}'))
        .otherwise(F.concat(F.lit('{"thought":"t","action":'), guess, F.lit("}")))
    )
    box = F.when(
        (F.col("l_linenumber") <= 3) & (F.col("l_discount") > 0.03),
        F.array(
            (x - 1) / 100.0, (y - 1) / 100.0, (x + 2) / 100.0, (y + 2) / 100.0
        ),
    )
    return line.select(
        _line_id().alias("id"),
        F.lit("action").alias("task"),
        F.lit("web").alias("benchmark"),
        F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("domain"),
        F.col("l_returnflag").alias("website_category"),
        (F.col("l_linestatus") == "O").alias("application_focused"),
        F.concat(F.lit("images/"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("image"),
        target.alias("target_action"),
        box.alias("bbox_normalized"),
        F.lit(1000).alias("image_width"),
        F.lit(500).alias("image_height"),
        prediction.alias("prediction"),
    )


ACTIONS_SQL = f"""
a0 AS (SELECT {_LINE_ID} AS id, l_suppkey, 'supplier' || l_suppkey::VARCHAR AS domain,
  l_returnflag AS website_category, l_linestatus = 'O' AS application_focused,
  'images/' || l_partkey::VARCHAR || '.jpg' AS image,
  CASE WHEN l_linenumber <= 3 THEN 'click' WHEN l_linenumber = 4 THEN 'scroll'
       WHEN l_linenumber = 5 THEN 'scroll_at' WHEN l_linenumber = 6 THEN 'mouse_drag_and_drop'
       ELSE 'keyboard_type' END AS target_name,
  l_linenumber <= 3 AND l_discount > 0.03 AS boxed,
  (l_quantity * 2)::INT AS x, (l_partkey % 101)::INT AS y,
  least((l_quantity * 2)::INT + (l_suppkey % 4)::INT, 100) AS px,
  (l_partkey % 15)::INT AS ddy, l_suppkey % 2 = 0 AS typed_right,
  l_tax < 0.06 OR (l_tax >= 0.07 AND l_tax < 0.08) AS action_parse_valid,
  l_tax < 0.06 AS action_name_correct,
  CASE WHEN l_tax >= 0.08 THEN 'invalid_json' WHEN l_tax >= 0.07 THEN NULL
       WHEN l_tax >= 0.06 THEN 'bad_coordinate' END AS parse_error
  FROM lineitem),
a1 AS (SELECT *,
  CASE WHEN action_name_correct AND target_name IN ('click', 'scroll_at')
    THEN abs(px / 100.0 * 1000 - x / 100.0 * 1000) END AS click_distance_px,
  CASE WHEN action_name_correct AND target_name = 'click' AND boxed THEN px <= x + 2
    END AS click_inside_bbox FROM a0),
a AS (SELECT *,
  coalesce(action_name_correct AND CASE target_name
    WHEN 'click' THEN CASE WHEN boxed THEN click_inside_bbox ELSE click_distance_px <= 25 END
    WHEN 'scroll' THEN ddy <= 10
    WHEN 'scroll_at' THEN click_distance_px <= 25 AND ddy <= 10
    WHEN 'mouse_drag_and_drop' THEN (px - x) * 10 <= 25
    ELSE typed_right END, false) AS action_arguments_correct,
  coalesce(action_name_correct AND CASE target_name
    WHEN 'click' THEN px = x WHEN 'scroll' THEN ddy = 0
    WHEN 'scroll_at' THEN px = x AND ddy = 0 WHEN 'mouse_drag_and_drop' THEN px = x
    ELSE typed_right END, false) AS action_exact FROM a1)
"""

# ---- lineitem: a long metrics table, one run per supplier -------------------------------------

METRIC_RULES = (
    ("qa", "answer_accuracy", "l_discount >= 0.05"),
    ("qa", "mean_token_f1", "l_discount < 0.08"),
    ("grounding", "click_accuracy", "l_quantity > 25"),
    ("grounding", "parse_rate", "l_discount < 0.09"),
    ("grounding", "median_pixel_distance", "l_quantity"),
    ("action", "action_name_accuracy", "l_tax >= 0.04"),
    ("action", "action_argument_accuracy", "l_tax >= 0.02"),
    ("action", "exact_action_accuracy", "l_linenumber > 3"),
    ("action", "click_inside_bbox_accuracy", "l_linestatus = 'O'"),
)
_SUITE = (
    "CASE l_returnflag WHEN 'A' THEN 'iid' WHEN 'N' THEN 'domain_balanced' "
    "ELSE 'distribution_shift' END"
)


def run_metrics(
    spark: SparkSession, folder: str, by: tuple[str, ...] = ("l_suppkey",)
) -> DataFrame:
    """Metrics per (run, suite); without ``by`` the whole table is the control run."""
    line = table(spark, folder, "lineitem").withColumn("suite", F.expr(_SUITE))
    wide = line.groupBy(*by, "suite").agg(
        *[
            F.avg(F.expr(f"CAST({rule} AS DOUBLE)")).alias(f"{task}/{metric}")
            for task, metric, rule in METRIC_RULES
        ]
    )
    names = [f"{task}/{metric}" for task, metric, _ in METRIC_RULES]
    long = wide.unpivot([*by, "suite"], names, "name", "value")
    return long.withColumns(
        {
            "task": F.split("name", "/")[0],
            "metric": F.split("name", "/")[1],
        }
    ).drop("name")


RUN_COLUMNS = {
    "run_id": "concat('run-', CAST(l_suppkey AS STRING))",
    "size": "CASE l_suppkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END",
    "seed": "CAST(l_suppkey % 7 AS INT)",
    "step": "CAST(500 + 500 * (l_suppkey % 2) AS INT)",
}


def candidate_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = run_metrics(spark, folder)
    return metrics.withColumns({k: F.expr(v) for k, v in RUN_COLUMNS.items()}).withColumn(
        "adapter_sha256", F.sha2(F.col("run_id"), 256)
    )


def control_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return run_metrics(spark, folder, ())


def metrics_sql(by: str = "l_suppkey") -> str:
    head = f"{by}, " if by else ""
    parts = [
        f"SELECT {head}{_SUITE} AS suite, '{task}' AS task, '{metric}' AS metric, "
        f"avg(({rule})::DOUBLE) AS value FROM lineitem GROUP BY {head}suite"
        for task, metric, rule in METRIC_RULES
    ]
    return " UNION ALL ".join(parts)


_RUN_SQL = ", ".join(
    f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in RUN_COLUMNS.items()
)
CANDIDATES_SQL = f"SELECT *, {_RUN_SQL} FROM ({metrics_sql()})"
CONTROL_SQL = metrics_sql("")

# ---- orders: paired episodes ------------------------------------------------------------------


def paired_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is a task run once by both variants."""
    orders = table(spark, folder, "orders")
    cells = F.array(
        F.struct(
            F.lit("control").alias("variant_id"),
            (F.col("o_orderstatus") == "F").alias("success"),
            (F.col("o_totalprice") / 100000.0).alias("total_reward"),
        ),
        F.struct(
            F.lit("candidate").alias("variant_id"),
            F.col("o_orderstatus").isin("F", "P").alias("success"),
            (F.col("o_totalprice") / 73331.7).alias("total_reward"),
        ),
    )
    return orders.select(
        F.col("o_orderkey").cast("string").alias("task_id"),
        (F.col("o_custkey") % 3).cast("int").alias("seed"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("steps_taken"),
        F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("parse_errors"),
        F.col("o_custkey"),
        F.explode(cells).alias("_c"),
    ).select("*", "_c.*").drop("_c")


EPISODES_SQL = """
SELECT o_orderkey::VARCHAR AS task_id, (o_custkey % 3)::INT AS seed,
  substr(o_orderpriority, 1, 1)::INT AS steps_taken,
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS parse_errors, o_custkey, variant_id,
  CASE WHEN variant_id = 'control' THEN o_orderstatus = 'F'
       ELSE o_orderstatus IN ('F', 'P') END AS success,
  CASE WHEN variant_id = 'control' THEN o_totalprice / 100000.0
       ELSE o_totalprice / 73331.7 END AS total_reward
FROM orders, (SELECT unnest(['control', 'candidate']) AS variant_id)
"""
