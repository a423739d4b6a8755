"""Nested source rows to examples.

A trajectory or a screenshot arrives as one row, so everything that looks at neighbouring steps or
messages (history, caps) is done on the row's own array before it is exploded: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus import schema
from agentcorpus.functions import actions, geometry, hashing, prompts, web
from agentcorpus.functions.text import blank_to, strip
from agentcorpus.operators import records


def page_state(step: Column, inventory: bool = True) -> Column:
    """Struct(index, title, url) of the active page.

    Two variants exist: the inventory falls back to the direct url and keeps 500 characters; the
    image-bearing one keeps 100 and writes ``about:blank`` for an empty url.
    """
    seen = step["other_obs"]
    index = F.coalesce(seen["page_index"], F.lit(0))
    titles, urls = seen["open_pages_titles"], seen["open_pages_urls"]
    in_titles = (index >= 0) & (index < F.coalesce(F.size(titles), F.lit(0)))
    in_urls = (index >= 0) & (index < F.coalesce(F.size(urls), F.lit(0)))
    title = F.when(in_titles, blank_to(F.get(titles, index), "New Tab")).otherwise("Unknown")
    listed = F.when(in_urls, F.get(urls, index))
    if inventory:
        direct = strip(F.coalesce(seen["url"], F.lit("")))
        url = blank_to(F.when(listed != "", listed).otherwise(direct), "Unknown")
        url = F.when(seen.isNull(), F.lit("Unknown")).otherwise(F.substring(url, 1, 500))
    else:
        url = F.when(in_urls, blank_to(listed, "about:blank")).otherwise("Unknown")
        url = F.substring(url, 1, 100)
    return F.struct(
        index.alias("index"), F.substring(title, 1, 100).alias("title"), url.alias("url")
    )


def parse_trajectories(df: DataFrame) -> DataFrame:
    """Open the two JSON columns; ``_steps`` is ordered by the integer step key."""
    opened = df.withColumns(
        {
            "_instruction": F.from_json("instruction", schema.INSTRUCTION),
            "_map": F.from_json("trajectory", schema.TRAJECTORY),
        }
    )
    steps = F.transform(
        F.map_entries("_map"),
        lambda e: F.struct(e["key"].try_cast("int").alias("step"), e["value"].alias("body")),
    )
    thoughts = F.transform(
        F.col("_steps"), lambda s: s["body"]["action"]["action_output"]["thought"]
    )
    keyed = opened.withColumn("_steps", _by_step(steps)).drop("_map")
    return keyed.withColumn(
        "_goal", records.select_goal(F.col("_instruction"), thoughts, F.col("sample_id"))
    )


def _by_step(steps: Column) -> Column:
    # Keys are unique within a map, so the large bodies need not take part in the comparison.
    return F.array_sort(
        steps,
        lambda a, b: F.when(a["step"] < b["step"], F.lit(-1)).when(
            a["step"] > b["step"], F.lit(1)
        ).otherwise(F.lit(0)),
    )


def trajectory_status(df: DataFrame) -> Column:
    """Why a parsed trajectory row cannot give examples; null when it can."""
    return (
        F.when(F.coalesce(strip(F.col("sample_id")), F.lit("")) == "", "malformed_row")
        .when(F.col("_instruction").isNull() | F.col("_steps").isNull(), "malformed_row")
        .when(F.exists("_steps", lambda s: s["step"].isNull()), "malformed_row")
        .when(F.col("_goal") == "", "no_valid_examples")
    )


def explode_trajectory(
    df: DataFrame,
    source: Mapping[str, str],
    max_past_steps: int,
    max_steps: int,
    locator: Mapping[str, Column] | None = None,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """One row per usable step with its history, prompt, answer and normalised action.

    History comes from all usable steps, and is built for the ``max_steps`` kept ones only.  With a
    suffix table domains are registrable ones.
    """
    # Unusable rows keep no steps.  A filter would be pushed below the parsing and repeat it, and so
    # would the filter Spark infers from a plain explode; hence the outer one.
    parsed = parse_trajectories(df)
    parsed = parsed.withColumn(
        "_steps", F.when(trajectory_status(parsed).isNull(), F.col("_steps"))
    )

    def usable(item):
        body = item["body"]
        output = body["action"]["action_output"]
        return F.struct(
            item["step"].alias("step"),
            strip(F.coalesce(body["screenshot"], F.lit(""))).alias("screenshot"),
            body["image_w"].alias("width"),
            body["image_h"].alias("height"),
            page_state(body).alias("page"),
            strip(F.coalesce(output["thought"], F.lit(""))).alias("thought"),
            strip(F.coalesce(output["action_name"], F.lit(""))).alias("name"),
            actions.opened(output["action"]).alias("raw"),
        )

    def normalized(s):
        done = actions.normalize_action(s["name"], s["raw"], s["width"], s["height"])
        kept = [s[f].alias(f) for f in ("step", "screenshot", "width", "height", "page", "thought")]
        return F.struct(*kept, done.alias("done"))

    prepared = parsed.withColumn(
        "_valid",
        F.filter(
            F.transform(
                F.filter(F.transform("_steps", usable), lambda s: s["screenshot"] != ""), normalized
            ),
            lambda s: s["done"]["action"].isNotNull(),
        ),
    ).drop("_steps", "_instruction", "instruction", "trajectory")

    def brief(s):
        return F.struct(
            s["step"].alias("step"), s["thought"].alias("thought"),
            s["done"]["action"].alias("action"),
        )

    valid = F.col("_valid")
    # (rank, place) pairs in the natural order of structs: no comparator, no copied steps
    ranks = F.array_sort(
        F.transform(
            valid,
            lambda s, i: F.struct(
                hashing.stable_key(
                    "inventory-step", source["id"], F.col("sample_id"), s["step"]
                ).alias("rank"),
                i.alias("place"),
            ),
        )
    )

    def with_history(pair):
        i = pair["place"]
        past = F.slice(
            valid,
            F.greatest(i - F.lit(max_past_steps), F.lit(0)) + 1,
            F.least(i, F.lit(max_past_steps)),
        )
        return F.struct(F.get(valid, i).alias("s"), F.transform(past, brief).alias("history"))

    kept = F.transform(F.slice(ranks, 1, max_steps), with_history)
    one = prepared.select("*", F.explode_outer(kept).alias("_one")).where(
        "_one is not null"
    ).drop("_valid")
    s, history = F.col("_one.s"), F.col("_one.history")
    page = s["page"]
    domain = web.host_domain(page["url"])
    fields = {
        **(dict(locator) if locator else {}),
        "kind": F.lit("trajectory_screenshot"),
        "screenshot": s["screenshot"],
    }
    place = records.image_locator(fields)
    examples = one.select(
        hashing.record_id(source["id"], F.col("sample_id"), s["step"]).alias("id"),
        F.lit(source.get("benchmark", "web_action")).alias("benchmark"),
        F.lit("action").alias("task"),
        F.lit(source["id"]).alias("source"),
        F.lit(source.get("role", "training")).alias("source_role"),
        F.lit(source.get("generator", "")).alias("generator"),
        F.col("sample_id").alias("trajectory_id"),
        s["step"].alias("step_index"),
        domain.alias("domain"),
        page["url"].alias("url"),
        F.col("_goal").alias("question"),
        prompts.action_prompt(
            F.col("_goal"), history, page["index"], page["title"], page["url"]
        ).alias("prompt"),
        actions.action_answer(s["thought"], s["done"]["action"]).alias("answer"),
        s["done"]["action"].alias("target_action"),
        actions.action_bbox(s["done"]["box"], s["width"], s["height"]).alias("bbox_normalized"),
        s["width"].alias("original_width"),
        s["height"].alias("original_height"),
        F.concat(F.lit("locator://"), records.locator_id(place)).alias("image"),
        place.alias("image_locator"),
        F.size(history).alias("history_steps"),
    )
    return web.registrable(examples, suffixes)


def trajectory_domain(df: DataFrame) -> DataFrame:
    """First step, in numeric order, whose page has a known domain."""
    parsed = parse_trajectories(df)
    domains = F.transform(
        F.coalesce(F.col("_steps"), F.array()),
        lambda s: web.host_domain(page_state(s["body"], inventory=False)["url"]),
    )
    known = F.filter(domains, lambda d: ~d.isin("", "unknown"))
    return parsed.withColumn("domain", F.coalesce(F.get(known, 0), F.lit("unknown"))).drop(
        "_steps", "_instruction", "_goal"
    )


def valid_message(message: Column, task: str, width: Column, height: Column) -> Column:
    asked = strip(F.coalesce(message["question"], F.lit(""))) != ""
    if task == "qa":
        return asked & (strip(F.coalesce(message["answer"], F.lit(""))) != "")
    box = F.from_json(message["bbox"], "array<double>")
    complete = F.coalesce(F.size(box) == 4, F.lit(False)) & ~F.exists(box, lambda v: v.isNull())
    return asked & complete & F.coalesce((width > 0) & (height > 0), F.lit(False))


def explode_messages(
    df: DataFrame,
    source: Mapping[str, str],
    max_messages: int,
    file: Column,
    row_index: Column,
    locator: Mapping[str, Column] | None = None,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """One row per usable message of a screenshot row, capped per row by hash order.

    With a suffix table domains are registrable ones.
    """
    task = source["task"]
    width, height = F.col("metadata.image_w"), F.col("metadata.image_h")
    base = df.withColumns({"_file": file, "_row": row_index})
    identified = F.transform(
        F.col("messages"),
        lambda m, i: F.struct(
            m.alias("m"),
            strip(F.coalesce(m["question"], F.lit(""))).alias("question"),
            hashing.record_id(
                source["id"], F.col("_file"), F.col("_row"), i,
                strip(F.coalesce(m["question"], F.lit(""))),
            ).alias("id"),
        ),
    )
    ranked = F.transform(
        F.filter(identified, lambda x: valid_message(x["m"], task, width, height)),
        lambda x: F.struct(
            hashing.stable_key("inventory-message", x["id"]).alias("rank"), x.alias("x")
        ),
    )
    kept = F.slice(
        F.array_sort(
            ranked,
            lambda a, b: F.when(a["rank"] < b["rank"], F.lit(-1)).when(
                a["rank"] > b["rank"], F.lit(1)
            ).otherwise(F.lit(0)),
        ),
        1,
        max_messages,
    )
    one = base.select("*", F.explode_outer(kept).alias("_one")).where("_one is not null")
    m, question = F.col("_one.x.m"), F.col("_one.x.question")
    url = strip(F.coalesce(F.col("metadata.url"), F.lit("")))
    fields = {
        **(dict(locator) if locator else {}),
        "file": F.col("_file"),
        "row_index": F.col("_row"),
        "kind": F.lit(
            "arrow_single_image" if source.get("format") == "arrow" else "single_image"
        ),
    }
    place = records.image_locator(fields)
    common = [
        F.col("_one.x.id").alias("id"),
        F.lit(source.get("benchmark", "web")).alias("benchmark"),
        F.lit(task).alias("task"),
        F.lit(source["id"]).alias("source"),
        F.lit(source.get("role", "training")).alias("source_role"),
        F.lit(source.get("generator", "")).alias("generator"),
        web.host_domain(url, F.col("metadata.website")).alias("domain"),
        F.coalesce(F.col("metadata.website"), F.lit("")).alias("website"),
        url.alias("url"),
        question.alias("question"),
        F.concat(F.lit("locator://"), records.locator_id(place)).alias("image"),
        place.alias("image_locator"),
    ]
    if task == "qa":
        answered = one.select(
            *common,
            prompts.qa_prompt(question).alias("prompt"),
            strip(m["answer"]).alias("answer"),
            blank_to(m["question_type"], "unknown").alias("question_type"),
            blank_to(m["question_form"], "unknown").alias("question_form"),
        )
        return web.registrable(answered, suffixes)
    box = geometry.normalize_bbox(F.from_json(m["bbox"], "array<double>"), width, height)
    staged = one.withColumn("_box", box)
    center = geometry.bbox_center(F.col("_box"))
    located = staged.select(
        *common,
        prompts.grounding_prompt(question).alias("prompt"),
        geometry.point_answer(center, question).alias("answer"),
        F.transform("_box", lambda v: F.bround(v, 4)).alias("bbox_normalized"),
        F.transform(center, lambda v: F.bround(v, 4)).alias("target_point_normalized"),
        width.alias("original_width"),
        height.alias("original_height"),
    )
    return web.registrable(located, suffixes)


def explode_benchmark_rows(
    df: DataFrame,
    box_format: str = "xyxy",
    units: str = "pixels",
    max_width: int = 1280,
    max_height: int = 1280,
    benchmark: str = "external",
) -> DataFrame:
    """External grounding rows (instruction, bbox, image size, data source and type) to records."""
    width, height = F.col("image_w"), F.col("image_h")
    instruction = strip(F.coalesce(F.col("instruction"), F.lit("")))
    kept = df.where((instruction != "") & (F.size("bbox") == 4))
    pixels = geometry.to_xyxy_pixels(F.col("bbox"), width, height, box_format, units)
    boxed = kept.withColumns(
        {
            "_box": geometry.normalize_bbox(pixels, width, height),
            "_size": geometry.target_dimensions(width, height, max_width, max_height),
            "_instruction": instruction,
        }
    )
    center = geometry.bbox_center(F.col("_box"))
    data_source = records.optional(df, "data_source")
    return boxed.select(
        F.format_string(f"{benchmark}-%05d", F.col("row_index")).alias("id"),
        F.lit(benchmark).alias("benchmark"),
        F.lit("grounding").alias("task"),
        F.col("_size.width").alias("image_width"),
        F.col("_size.height").alias("image_height"),
        width.alias("original_width"),
        height.alias("original_height"),
        blank_to(data_source, benchmark).alias("domain"),
        F.lit("").alias("url"),
        F.col("_instruction").alias("question"),
        prompts.grounding_prompt(F.col("_instruction")).alias("prompt"),
        geometry.point_answer(center, F.col("_instruction")).alias("answer"),
        F.transform("_box", lambda v: F.bround(v, 4)).alias("bbox_normalized"),
        F.transform(center, lambda v: F.bround(v, 4)).alias("target_point_normalized"),
        blank_to(records.optional(df, "data_type"), "unknown").alias("element_type"),
        blank_to(data_source, "unknown").alias("data_source"),
    )


def history_frame(
    steps: DataFrame, trajectory: str, step: str, fields: list[str], past: int,
    span: int = 256,
) -> DataFrame:
    """Last ``past`` earlier steps of each row of a step table, oldest first.

    Steps are numbered densely first, so gaps in the step numbers do not shorten the history.  A
    trajectory is then cut into spans of numbers, and each row that ends a span is also sent to the
    following spans its successors may look back from, so one endless trajectory becomes many small
    windows.
    """
    if past <= 0:
        return steps.withColumn("history", F.array().cast(_history_type(steps, step, fields)))
    dense = dense_steps(steps, trajectory, step, "_dense")
    own = F.floor(F.col("_dense") / span)
    reach = F.floor((F.col("_dense") + past) / span)
    copied = dense.select("*", F.explode(F.sequence(own, reach)).alias("_span")).withColumn(
        "_own", F.col("_span") == own
    )
    window = W.partitionBy(trajectory, "_span").orderBy("_dense").rowsBetween(-past, -1)
    item = F.struct(F.col(step).alias("step"), *[F.col(f) for f in fields])
    return (
        copied.withColumn("history", F.collect_list(item).over(window))
        .where("_own")
        .drop("_span", "_own", "_dense")
    )


def _history_type(df: DataFrame, step: str, fields: list[str]) -> str:
    kinds = dict(df.dtypes)
    inner = ", ".join([f"step:{kinds[step]}"] + [f"{f}:{kinds[f]}" for f in fields])
    return f"array<struct<{inner}>>"


def dense_steps(steps: DataFrame, trajectory: str, step: str, out: str = "position") -> DataFrame:
    """0-based dense position of each step inside its trajectory, safe for a hot trajectory."""
    from agentcorpus.operators.ranking import ranked

    bucket = F.floor(F.col(step) / 1024).cast("bigint")
    numbered = ranked(steps, [trajectory], [F.col(step)], bucket, out)
    return numbered.withColumn(out, (F.col(out) - 1).cast("bigint"))


def cap_steps(
    steps: DataFrame, source: Column, trajectory: str, step: str, max_steps: int
) -> DataFrame:
    """Keep ``max_steps`` per trajectory of a step table by stable hash."""
    from agentcorpus.operators.ranking import first_few

    key = hashing.stable_key("inventory-step", source, F.col(trajectory), F.col(step))
    return first_few(steps.withColumn("_key", key), [trajectory], [F.col("_key")], max_steps).drop(
        "_key", "rank"
    )
