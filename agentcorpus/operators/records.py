"""Derived columns every other operator starts from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions import web
from agentcorpus.functions.staging import staged
from agentcorpus.functions.text import blank_to, strip


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def field_or(df: DataFrame, name: str, default: str = "unknown") -> Column:
    return blank_to(optional(df, name), default)


def sampling_unit(df: DataFrame) -> Column:
    """Trajectory, else image, else the record itself."""

    def tagged(name, prefix):
        value = optional(df, name)
        return F.when(value != "", F.concat(F.lit(prefix), value))

    return F.coalesce(
        tagged("trajectory_id", "trajectory:"),
        tagged("image", "image:"),
        F.concat(F.lit("record:"), F.col("id").cast("string")),
    )


def with_unit(df: DataFrame) -> DataFrame:
    return df.withColumn("unit", sampling_unit(df))


def canonicalize_domain_column(df: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Lower-case recorded or derived domains; registrable ones where a suffix table is given."""
    named = df.withColumn(
        "domain",
        web.canonical_domain(optional(df, "domain"), optional(df, "url"), optional(df, "website")),
    )
    return web.registrable(named, suffixes)


def annotate_website(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    suffixes: DataFrame | None = None,
    rule_table: bool = False,
) -> DataFrame:
    """Host, surface and category of the website; with a suffix table also canonical domains.

    ``rule_table`` is for thousands of rules, see :func:`web.classify_website`.
    """
    if suffixes is not None:
        df = canonicalize_domain_column(df, suffixes)
    url = F.coalesce(optional(df, "url"), F.lit(""))
    surface = web.website_surface(url, optional(df, "website"))
    named = staged(df, {"hostname": web.hostname(url), "website_surface": surface})
    verdict = web.classify_website(
        field_or(named, "domain"), F.col("website_surface"), url, rules, rule_table
    )
    judged = staged(named, {"_verdict": verdict})
    return judged.withColumns(
        {
            name: F.col(f"_verdict.{name}")
            for name in (
                "website_category", "website_category_confidence", "website_category_rule",
            )
        }
    ).drop("_verdict").withColumn(
        "application_focused", web.application_focused(F.col("website_category"))
    )


def image_locator(fields: Mapping[str, Column]) -> Column:
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def locator_id(locator: Column) -> Column:
    """First 24 hex digits of the digest of the locator's compact JSON, keys in sorted order.

    The struct's fields must be in sorted order, as :func:`image_locator` builds them.
    """
    return F.substring(F.sha2(F.to_json(locator), 256), 1, 24)


def display_projection(df: DataFrame, image: str = "image_path") -> DataFrame:
    """Flat browsing row."""
    picture = optional(df, image)
    has_locator = "image_locator" in df.columns
    return df.select(
        "id",
        optional(df, "task").alias("task"),
        optional(df, "domain").alias("domain"),
        optional(df, "website_surface").alias("surface"),
        optional(df, "website_category").alias("category"),
        optional(df, "website_category_confidence").alias("category_confidence"),
        optional(df, "source").alias("source"),
        optional(df, "url").alias("url"),
        optional(df, "question").alias("question"),
        optional(df, "answer").alias("answer"),
        optional(df, "question_type").alias("question_type"),
        picture.alias("image"),
        picture.isNotNull().alias("image_available"),
        (F.col("image_locator.file") if has_locator else F.lit(None).cast("string")).alias(
            "image_source_file"
        ),
    )


def training_rows(df: DataFrame) -> DataFrame:
    from agentcorpus.functions import prompts

    return df.select(
        "id",
        prompts.training_prompt(F.col("task"), F.col("prompt")).alias("prompt"),
        prompts.training_completion(F.col("answer")).alias("completion"),
        "image",
    )


def inference_rows(df: DataFrame) -> DataFrame:
    from agentcorpus.functions import prompts

    return df.select(
        "id",
        prompts.inference_messages(F.col("task"), F.col("prompt"), F.col("image")).alias(
            "messages"
        ),
    )


def select_goal(instruction: Column, thoughts: Column, key: Column) -> Column:
    """Explicit goal, else a 40/40/20 choice among the levels given, else the first thought."""
    from agentcorpus.functions.hashing import stable_key, key_prefix

    goal = strip(F.coalesce(instruction["goal"], F.lit("")))
    levels = [
        (strip(F.coalesce(instruction[name], F.lit(""))), weight)
        for name, weight in (("high_level", 40), ("mid_level", 40), ("low_level", 20))
    ]
    total = F.lit(0).cast("bigint")
    for level, weight in levels:
        total = total + F.when(level != "", F.lit(weight)).otherwise(F.lit(0))
    hashed = stable_key("goal", key)
    divisor = F.when(total > 0, total)
    high = key_prefix(hashed, 8) % divisor
    low = F.conv(F.substring(hashed, 9, 8), 16, 10).cast("bigint") % divisor
    bucket = (high * (F.lit(1 << 32) % divisor) + low) % divisor
    chosen, upto = None, F.lit(0).cast("bigint")
    for level, weight in levels:
        upto = upto + F.when(level != "", F.lit(weight)).otherwise(F.lit(0))
        hit = (level != "") & (bucket < upto)
        chosen = F.when(hit, level) if chosen is None else chosen.when(hit, level)
    first_thought = F.get(F.filter(thoughts, lambda t: strip(F.coalesce(t, F.lit(""))) != ""), 0)
    return (
        F.when(goal != "", goal)
        .when(total > 0, chosen)
        .otherwise(F.coalesce(strip(first_thought), F.lit("")))
    )
