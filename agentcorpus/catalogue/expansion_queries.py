"""Nested rows to examples, prompts and actions.

Raw trajectory and screenshot rows are derived from whole document texts: each line of a text is one
step, or one message.  Rows are as long as the texts are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, sql_key, sql_mod, table
from agentcorpus.functions import actions, prompts
from agentcorpus.operators import expand, records
from agentcorpus.session import spread

WIDTH, HEIGHT = 1280, 720
PAST, KEEP = 2, 5
SOURCE = {"id": "docs", "role": "training", "generator": "lines", "benchmark": "web_action"}


def raw_trajectories(spark, folder):
    docs = spread(table(spark, folder, "documents"), "doc_id")

    def step(line, i):
        n = F.length(line)
        name = F.when(n % 4 == 1, "scroll").when(n % 4 == 2, "keyboard_type").otherwise("click")
        number = n.cast("string")
        raw = (
            F.when(n % 4 == 1, F.concat(F.lit('{"delta_x":0,"delta_y":'), number, F.lit("}")))
            .when(n % 4 == 2, F.concat(F.lit('{"text":"'), F.col("source"), F.lit('","bbox":null}')))
            .when(n % 4 == 3, F.concat(F.lit('{"x":'), number, F.lit(',"y":'), number, F.lit("}")))
            .when(n % 7 == 0, F.lit('{"bbox":[1,2,0,5]}'))
            .otherwise(
                F.concat(
                    F.lit('{"bbox":['), number, F.lit(","), number, F.lit(',50,20],"button":"left"}')
                )
            )
        )
        output = F.struct(
            line.alias("thought"), name.alias("action_name"), F.parse_json(raw).alias("action")
        )
        page = F.concat(
            F.lit("https://www."), F.col("source"), F.lit(".example.com/"), i.cast("string")
        )
        seen = F.struct(
            (i % 3).cast("int").alias("page_index"),
            F.array(F.lit("T0"), F.lit("")).alias("open_pages_titles"),
            F.array(page, F.lit("")).alias("open_pages_urls"),
            F.lit("https://direct.example.org/a b").alias("url"),
        )
        return F.struct(
            F.when(n % 5 == 0, "").otherwise(
                F.format_string("screenshot_%03d.png", i + 1)
            ).alias("screenshot"),
            F.lit(WIDTH).alias("image_w"),
            F.lit(HEIGHT).alias("image_h"),
            seen.alias("other_obs"),
            F.struct(output.alias("action_output")).alias("action"),
        )

    entries = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(i.cast("string").alias("key"), step(line, i).alias("value")),
    )
    level = F.when(F.col("lang") == "de", "").otherwise(F.col("source"))
    instruction = F.struct(
        F.when(F.col("lang") == "en", F.concat(F.lit(" Find "), "source")).alias("goal"),
        F.concat(F.when(level != "", F.lit("high ")).otherwise(""), level).alias("high_level"),
        F.concat(F.when(level != "", F.lit("mid ")).otherwise(""), level).alias("mid_level"),
        F.when(F.col("lang") == "fr", "low").otherwise("").alias("low_level"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.to_json(instruction).alias("instruction"),
        F.to_json(F.map_from_entries(entries)).alias("trajectory"),
    )


_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def _strip(text: str) -> str:
    return f"trim({text}, {_WS})"


_BUCKET100 = sql_mod(100, "'goal'", "sample_id")
_BUCKET80 = sql_mod(80, "'goal'", "sample_id")
LINES_SQL = f"""
d AS (SELECT doc_id::VARCHAR AS sample_id, source, lang, string_split(text, chr(10)) AS parts
      FROM documents),
f AS (SELECT sample_id, source, lang, unnest(parts) AS line,
        generate_subscripts(parts, 1) - 1 AS i FROM d),
th AS (SELECT sample_id, arg_min({_strip('line')}, i) AS first_thought FROM f
       WHERE {_strip('line')} <> '' GROUP BY sample_id),
goals AS (SELECT d.sample_id, CASE lang WHEN 'en' THEN 'Find ' || source
    WHEN 'fr' THEN CASE WHEN {_BUCKET100} < 40 THEN 'high ' || source
      WHEN {_BUCKET100} < 80 THEN 'mid ' || source ELSE 'low' END
    WHEN 'de' THEN coalesce(first_thought, '')
    ELSE CASE WHEN {_BUCKET80} < 40 THEN 'high ' || source ELSE 'mid ' || source END END AS goal
  FROM d LEFT JOIN th USING (sample_id)),
s AS (SELECT f.*, goal, length(line) AS n, {_strip('line')} AS thought FROM f JOIN goals USING (sample_id)),
v AS (SELECT *,
    CASE WHEN n % 4 = 1 THEN '{{"name":"scroll","delta_x":0.0,"delta_y":'
        || round_even(n / {HEIGHT}::DOUBLE * 100, 1)::VARCHAR || '}}'
      WHEN n % 4 = 2 THEN '{{"name":"keyboard_type","text":"' || source || '"}}'
      WHEN n % 4 = 3 THEN '{{"name":"click","x":'
        || round_even(least(100.0::DOUBLE, n / {WIDTH}::DOUBLE * 100), 1)::VARCHAR || ',"y":'
        || round_even(least(100.0::DOUBLE, n / {HEIGHT}::DOUBLE * 100), 1)::VARCHAR
        || ',"button":"","click_type":""}}'
      ELSE '{{"name":"click","x":'
        || round_even(least(100.0::DOUBLE, (n + 25.0::DOUBLE) / {WIDTH}::DOUBLE * 100), 1)::VARCHAR
        || ',"y":'
        || round_even(least(100.0::DOUBLE, (n + 10.0::DOUBLE) / {HEIGHT}::DOUBLE * 100), 1)::VARCHAR
        || ',"button":"left","click_type":""}}' END AS action,
    CASE i % 3 WHEN 0 THEN 'https://www.' || source || '.example.com/' || i::VARCHAR
      ELSE 'https://direct.example.org/a b' END AS url,
    CASE i % 3 WHEN 0 THEN 'T0' WHEN 1 THEN 'New Tab' ELSE 'Unknown' END AS title
  FROM s WHERE n % 5 <> 0 AND NOT (n % 4 = 0 AND n % 7 = 0) AND goal <> ''),
h AS (SELECT *, list('## Step ' || i::VARCHAR || chr(10) || 'THOUGHT: ' || thought || chr(10)
      || 'ACTION: ' || action) OVER w AS blocks,
    row_number() OVER (PARTITION BY sample_id ORDER BY
      {sql_key("'inventory-step'", "'docs'", 'sample_id', 'i::VARCHAR')}) AS rk
  FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY i ROWS BETWEEN {PAST} PRECEDING AND 1 PRECEDING))
"""


@query(
    "explode_trajectory",
    f"""WITH {LINES_SQL} SELECT substr(sha256(concat_ws(chr(31), 'docs', sample_id, i::VARCHAR)), 1, 24)
      AS id, sample_id AS trajectory_id, i::INT AS step_index, goal AS question,
      CASE i % 3 WHEN 0 THEN source || '.example.com' ELSE 'direct.example.org' END AS domain, url,
      action AS target_action, coalesce(len(blocks), 0)::INT AS history_steps,
      sha256(trim('# GOAL' || chr(10) || goal || chr(10) || chr(10) || '# PREVIOUS STEPS' || chr(10)
        || CASE WHEN coalesce(len(blocks), 0) = 0 THEN '' ELSE array_to_string(blocks, chr(10))
           || chr(10) END
        || '# CURRENTLY ACTIVE PAGE' || chr(10) || 'Page ' || (i % 3)::VARCHAR || ': ' || title
        || ' | ' || url || chr(10) || chr(10) || '# NEXT STEP', {_WS})) AS prompt_hash,
      CASE WHEN n % 4 = 0 THEN n / {WIDTH}::DOUBLE END AS box_left
    FROM h WHERE rk <= {KEEP}""",
)
def explode_trajectory(spark, folder):
    examples = expand.explode_trajectory(raw_trajectories(spark, folder), SOURCE, PAST, KEEP)
    return examples.select(
        "id", "trajectory_id", "step_index", "question", "domain", "url", "target_action",
        "history_steps", F.sha2("prompt", 256).alias("prompt_hash"),
        F.get("bbox_normalized", F.lit(0)).alias("box_left"),
    )


@query("select_goal", f"WITH {LINES_SQL} SELECT sample_id, goal FROM goals")
def select_goal(spark, folder):
    parsed = expand.parse_trajectories(raw_trajectories(spark, folder))
    return parsed.select("sample_id", F.col("_goal").alias("goal"))


@query(
    "trajectory_domain",
    f"""WITH {LINES_SQL} SELECT sample_id, source || '.example.com' AS domain FROM d""",
)
def trajectory_domain(spark, folder):
    return expand.trajectory_domain(raw_trajectories(spark, folder)).select("sample_id", "domain")


@query(
    "page_state",
    f"""WITH {LINES_SQL}, b AS (SELECT i % 3 AS k, 'https://www.' || source || '.example.com/'
        || i::VARCHAR AS page FROM f)
    SELECT k::INT AS page_index, CASE k WHEN 0 THEN 'T0' WHEN 1 THEN 'New Tab' ELSE 'Unknown' END
      AS title, CASE k WHEN 0 THEN page ELSE 'https://direct.example.org/a b' END AS inventory_url,
      CASE k WHEN 0 THEN page WHEN 1 THEN 'about:blank' ELSE 'Unknown' END AS image_url,
      count(*)::BIGINT AS n FROM b GROUP BY ALL""",
)
def page_state(spark, folder):
    """Both page-state variants of every step."""
    parsed = expand.parse_trajectories(raw_trajectories(spark, folder))
    steps = parsed.select(F.explode("_steps").alias("s"))
    body = F.col("s.body")
    states = steps.select(
        expand.page_state(body).alias("a"), expand.page_state(body, inventory=False).alias("b")
    )
    return states.groupBy(
        F.col("a.index").alias("page_index"), F.col("a.title").alias("title"),
        F.col("a.url").alias("inventory_url"), F.col("b.url").alias("image_url"),
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- screenshot rows --------------------------------------------------------------------------


def raw_screenshots(spark, folder):
    docs = spread(table(spark, folder, "documents"), "doc_id")

    def message(line):
        n = F.length(line)
        number = n.cast("string")
        box = F.when(n % 4 == 0, "[1,2]").when(n % 4 == 1, "oops").otherwise(
            F.concat(F.lit("["), number, F.lit(",10,"), (n + 100).cast("string"), F.lit(",90]"))
        )
        return F.struct(
            line.alias("question"),
            F.when(n % 4 == 0, " ").otherwise(F.col("lang")).alias("answer"),
            F.when(n % 2 == 0, F.col("source")).otherwise("").alias("question_type"),
            F.lit(None).cast("string").alias("question_form"),
            box.alias("bbox"),
        )

    return docs.select(
        "doc_id",
        F.struct(
            F.lit("").alias("website"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/x")).alias("url"),
            F.lit(1000).alias("image_w"),
            F.lit(500).alias("image_h"),
        ).alias("metadata"),
        F.transform(F.split("text", "\n"), message).alias("messages"),
    )


def _messages_sql(task: str, valid: str) -> str:
    identity = (
        f"substr(sha256(concat_ws(chr(31), '{task}-source', 'documents', doc_id::VARCHAR, "
        "i::VARCHAR, question)), 1, 24)"
    )
    return f"""
d AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents),
f AS (SELECT doc_id, source, lang, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i FROM d),
m AS (SELECT *, length(line) AS n, {_strip('line')} AS question FROM f),
x AS (SELECT *, {identity} AS id FROM m WHERE question <> '' AND {valid}),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id
        ORDER BY {sql_key("'inventory-message'", 'id')}) <= 3)
"""


@query(
    "explode_messages",
    f"""WITH {_messages_sql('qa', 'n % 4 <> 0')} SELECT id, source || '.example.com' AS domain,
        question, lang AS answer, CASE WHEN n % 2 = 0 THEN source ELSE 'unknown' END AS question_type,
        'unknown' AS question_form, question || chr(10) || 'Answer using only the screenshot.' AS prompt
        FROM k""",
)
def explode_messages(spark, folder):
    rows = expand.explode_messages(
        raw_screenshots(spark, folder), {"id": "qa-source", "task": "qa"}, 3,
        F.lit("documents"), F.col("doc_id"),
    )
    return rows.select(
        "id", "domain", "question", "answer", "question_type", "question_form", "prompt"
    )


_CX = "least(1000.0::DOUBLE, n / 1000::DOUBLE * 1000)"
_CX2 = "least(1000.0::DOUBLE, (n + 100) / 1000::DOUBLE * 1000)"


@query(
    "explode_grounding_messages",
    f"""WITH {_messages_sql('grounding', 'n % 4 > 1')} SELECT id, question,
        round({_CX}, 4) AS left_edge, 180.0::DOUBLE AS bottom_edge,
        round(({_CX} + {_CX2}) / 2, 4) AS target_x, 100.0::DOUBLE AS target_y FROM k""",
)
def explode_grounding_messages(spark, folder):
    rows = expand.explode_messages(
        raw_screenshots(spark, folder), {"id": "grounding-source", "task": "grounding"}, 3,
        F.lit("documents"), F.col("doc_id"),
    )
    box, point = F.col("bbox_normalized"), F.col("target_point_normalized")
    return rows.select(
        "id", "question", box[0].alias("left_edge"), box[3].alias("bottom_edge"),
        point[0].alias("target_x"), point[1].alias("target_y"),
    )


@query(
    "valid_message",
    f"""WITH m AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT {_strip('line')} <> '' AS asked, length(line) % 4 AS n FROM m)
    SELECT (asked AND n <> 0) AS qa, (asked AND n > 1) AS grounding, count(*)::BIGINT AS n
    FROM k GROUP BY ALL""",
)
def valid_message(spark, folder):
    rows = raw_screenshots(spark, folder).select(F.explode("messages").alias("m"), "metadata")
    width, height = F.col("metadata.image_w"), F.col("metadata.image_h")
    checks = {
        task: expand.valid_message(F.col("m"), task, width, height) for task in ("qa", "grounding")
    }
    return rows.select(*[c.alias(t) for t, c in checks.items()]).groupBy("qa", "grounding").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- external grounding rows ------------------------------------------------------------------


@query(
    "explode_benchmark_rows",
    """SELECT 'external-' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0')
         AS id, p_brand AS domain, p_name AS question, p_type AS element_type, 1280::INT AS image_width,
       720::INT AS image_height, round(p_size / 1600::DOUBLE * 1000, 4) AS left_edge,
       round(((p_size + p_size + 20) / 1600::DOUBLE * 1000) / 2, 4) AS target_x,
       '[{"point_2d":[' || round_even(((p_size + p_size + 20) / 1600::DOUBLE * 1000) / 2, 0)::INT::VARCHAR
         || ',' || round_even((p_size + p_size + 10) / 900::DOUBLE * 1000 / 2, 0)::INT::VARCHAR
         || '],"label":"' || p_name || '"}]' AS answer FROM part""",
)
def explode_benchmark_rows(spark, folder):
    size = F.col("p_size").cast("double")
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_index"), F.col("p_name").alias("instruction"),
        F.array(size, size, F.lit(20.0), F.lit(10.0)).alias("bbox"),
        F.lit(1600).alias("image_w"), F.lit(900).alias("image_h"),
        F.col("p_brand").alias("data_source"), F.col("p_type").alias("data_type"),
    )
    out = expand.explode_benchmark_rows(rows, "xywh", "pixels", 1280, 720)
    return out.select(
        "id", "domain", "question", "element_type", "image_width", "image_height",
        F.col("bbox_normalized")[0].alias("left_edge"),
        F.col("target_point_normalized")[0].alias("target_x"), "answer",
    )


# ---- step tables ------------------------------------------------------------------------------


@query(
    "history_frame",
    """SELECT trajectory_id, step_index, coalesce(array_to_string(h, '|'), '') AS history FROM (
         SELECT conv_id::VARCHAR AS trajectory_id, turn AS step_index,
           list(turn::VARCHAR || ':' || role) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h FROM conversations)""",
)
def history_frame(spark, folder):
    steps = B.conversation_steps(spark, folder).drop("thought")
    # A span of four steps makes even these short conversations cross spans.
    framed = expand.history_frame(steps, "trajectory_id", "step_index", ["action"], 3, span=4)
    text = F.transform(
        "history", lambda h: F.concat_ws(":", h["step"].cast("string"), h["action"])
    )
    return framed.select("trajectory_id", "step_index", F.array_join(text, "|").alias("history"))


@query(
    "dense_steps",
    """SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT
       AS position FROM events""",
)
def dense_steps(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id")
    return expand.dense_steps(rows, "user_id", "event_id")


@query(
    "cap_steps",
    f"""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY
        {sql_key("'inventory-step'", 'event_type', 'user_id', 'event_id')}) <= 4""",
)
def cap_steps(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return expand.cap_steps(rows, F.col("event_type"), "user_id", "event_id", 4).select(
        "user_id", "event_id"
    )


# ---- actions ----------------------------------------------------------------------------------


@query(
    "normalize_action",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q,
         (l_partkey % 1400)::INT AS px FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE
      WHEN l_linenumber <= 2 THEN '{"name":"click","x":' || round_even(least(100::DOUBLE,
         (px + q / 2::DOUBLE) / 1280::DOUBLE * 100), 1)::VARCHAR || ',"y":' || round_even(least(100::DOUBLE,
         (q + 5::DOUBLE) / 720::DOUBLE * 100), 1)::VARCHAR || ',"button":"","click_type":"single"}'
      WHEN l_linenumber = 3 THEN NULL
      WHEN l_linenumber = 4 THEN '{"name":"scroll","delta_x":' || round_even(-q / 1280::DOUBLE * 100, 1)
         ::VARCHAR || ',"delta_y":' || round_even(px / 720::DOUBLE * 100, 1)::VARCHAR || '}'
      WHEN l_linenumber = 5 THEN NULL
      ELSE '{"name":"press","key":"Enter","n":' || q::VARCHAR || '}' END AS action,
      CASE WHEN l_linenumber <= 2 THEN px / 1280::DOUBLE END AS box_left FROM a""",
)
def normalize_action(spark, folder):
    line = table(spark, folder, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    px = (F.col("l_partkey") % 1400).cast("int").cast("string")
    number = F.col("l_linenumber")
    name = (
        F.when(number <= 3, "click").when(number == 4, "scroll").when(number == 5, " ")
        .otherwise("press")
    )
    raw = (
        F.when(number <= 2, F.concat(
            F.lit('{"bbox":['), px, F.lit(","), q, F.lit(","), q, F.lit(',10],"click_type":"single"}')))
        .when(number == 3, F.lit('{"x":true,"y":3}'))
        .when(number == 4, F.concat(F.lit('{"delta_x":-'), q, F.lit(',"delta_y":'), px, F.lit("}")))
        .otherwise(F.concat(F.lit('{"key":"Enter","n":'), q, F.lit(',"bbox":[1]}')))
    )
    done = spread(line, "l_orderkey", "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.trim(name).alias("name"), actions.opened(raw).alias("raw"),
    ).withColumn(
        "d", actions.normalize_action(F.col("name"), F.col("raw"), F.lit(1280), F.lit(720))
    )
    box = actions.action_bbox(F.col("d.box"), F.lit(1280), F.lit(720))
    return done.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("d.action").alias("action"),
        F.get(box, F.lit(0)).alias("box_left"),
    )


@query(
    "rollout_action",
    f"""WITH {B.ACTIONS_SQL} SELECT CASE target_name WHEN 'click' THEN 'click'
        WHEN 'keyboard_type' THEN 'type' WHEN 'scroll' THEN CASE WHEN dy > 0 THEN 'scroll' END END
        AS action, CASE WHEN target_name = 'scroll' AND dy = 0 THEN 'scroll_needs_delta'
          WHEN target_name IN ('scroll_at', 'mouse_drag_and_drop') THEN 'unsupported' END AS error,
        count(*)::BIGINT AS n, round(sum(CASE WHEN target_name = 'click' THEN x / 100.0::DOUBLE END), 4)
          AS sum_x, round(sum(CASE WHEN target_name = 'scroll' AND dy > 0 THEN dy / 100.0::DOUBLE END), 4)
          AS sum_amount
        FROM (SELECT a.*, (l_suppkey % 30)::INT AS dy FROM a) GROUP BY 1, 2""",
)
def rollout_action(spark, folder):
    rows = B.action_predictions(spark, folder).select(
        actions.opened(F.col("target_action")).alias("value")
    ).select(actions.rollout_action(F.col("value")).alias("r"))
    return rows.groupBy("r.action", "r.error").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("r.x"), 4).alias("sum_x"),
        F.round(F.sum("r.amount"), 4).alias("sum_amount"),
    )


# ---- chat rows --------------------------------------------------------------------------------

_SYSTEM = {k: v.replace("'", "''") for k, v in prompts.SYSTEM_PROMPTS.items()}
_SYSTEM_SQL = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SYSTEM.items()) + " END"


def _chat_input(spark, folder):
    docs = table(spark, folder, "documents")
    return B.document_records(spark, folder).join(
        docs.select(F.col("doc_id").cast("string").alias("id"), "text"), "id"
    ).select("id", "task", "image", F.col("text").alias("prompt"), F.col("source").alias("answer"))


@query(
    "training_rows",
    f"""SELECT r.id, {_SYSTEM_SQL} AS system, text AS prompt, r.source AS completion, image
        FROM ({B.DOCUMENTS_SQL}) r JOIN documents d ON r.id = d.doc_id::VARCHAR""",
)
def training_rows(spark, folder):
    rows = records.training_rows(_chat_input(spark, folder))
    return rows.select(
        "id", F.col("prompt")[0]["content"].alias("system"),
        F.col("prompt")[1]["content"].alias("prompt"),
        F.col("completion")[0]["content"].alias("completion"), "image",
    )


@query(
    "inference_messages",
    f"""SELECT r.id, {_SYSTEM_SQL} AS system, image, text AS prompt
        FROM ({B.DOCUMENTS_SQL}) r JOIN documents d ON r.id = d.doc_id::VARCHAR""",
)
def inference_messages(spark, folder):
    rows = records.inference_rows(_chat_input(spark, folder))
    user = F.col("messages")[1]["content"]
    return rows.select(
        "id", F.col("messages")[0]["content"][0]["text"].alias("system"),
        user[0]["image"].alias("image"), user[1]["text"].alias("prompt"),
    )


@query(
    "compose_answer",
    """SELECT conv_id, turn, '{"thought":' || to_json(trim(text))::VARCHAR || ',"action":{"name":"'
       || role || '","n":' || turn::VARCHAR || '}}' AS answer FROM conversations""",
)
def compose_answer(spark, folder):
    turns = table(spark, folder, "conversations")
    action = F.concat(
        F.lit('{"name":"'), "role", F.lit('","n":'), F.col("turn").cast("string"), F.lit("}")
    )
    return turns.select(
        "conv_id", "turn", actions.action_answer(F.trim("text"), action).alias("answer")
    )
