"""Diversity audits, distributions and macro metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentcorpus.operators import records
from agentcorpus.operators.ranking import first_few
from agentcorpus.operators.rows import single_row


def record_profile(df: DataFrame) -> DataFrame:
    """Counts per (kind, value) for every dimension an audit needs, in one pass and one shuffle.

    Each row is turned into its dimension values and counted; the partial aggregate collapses hot
    values before the shuffle, so neither a dominant domain nor a dominant unit is moved row by row.
    """
    task = records.optional(df, "task")
    action = (
        F.get_json_object(records.optional(df, "target_action"), "$.name")
        if "target_action" in df.columns
        else records.optional(df, "action_name")
    )

    def pair(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    def nonempty(name):
        value = records.optional(df, name)
        return F.when(value != "", value)

    pairs = F.array(
        pair("domain", records.field_or(df, "domain")),
        pair("sampling_unit", records.sampling_unit(df)),
        pair("trajectory", nonempty("trajectory_id")),
        pair("image", nonempty("image")),
        pair("task", records.field_or(df, "task")),
        pair("source", records.field_or(df, "source")),
        pair("website_category", records.field_or(df, "website_category", "unclassified")),
        pair(
            "application_focused",
            F.coalesce(records.optional(df, "application_focused", "boolean"), F.lit(False)),
        ),
        pair("action", F.when(task == "action", F.coalesce(F.when(action != "", action), F.lit("unknown")))),
        pair("question_type", F.when(task == "qa", records.field_or(df, "question_type"))),
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .where("p.value is not null")
        .groupBy(F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def audit(df: DataFrame) -> DataFrame:
    """One row of concentration and uniqueness figures; zeros for an empty table."""
    profile = record_profile(df)
    top = first_few(
        profile.where("kind = 'domain'"), ["kind"], [F.desc("n"), F.col("value")], 5
    ).select(F.lit("top_domain").alias("kind"), "value", "n")
    n = F.col("n").cast("double")

    def total(kind, value="n"):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0)).cast(
            "bigint"
        )

    def distinct(kind):
        return F.count_if(F.col("kind") == kind)

    examples = total("domain")
    squares = F.sum(F.when(F.col("kind") == "domain", n * n))
    largest = F.max(F.when(F.col("kind") == "domain", F.col("n")))
    focused = F.sum(
        F.when((F.col("kind") == "application_focused") & (F.col("value") == "true"), F.col("n"))
    )

    def share(part):
        return F.coalesce(part / F.nullif(examples, F.lit(0)), F.lit(0.0)).cast("double")

    return profile.unionByName(top).agg(
        examples.alias("examples"),
        distinct("domain").alias("unique_domains"),
        distinct("sampling_unit").alias("unique_sampling_units"),
        distinct("trajectory").alias("unique_trajectories"),
        distinct("image").alias("unique_images"),
        share(largest).alias("max_domain_share"),
        share(total("top_domain")).alias("top_5_domain_share"),
        F.coalesce(
            examples.cast("double") * examples.cast("double") / squares, F.lit(0.0)
        ).alias("effective_domains"),
        share(focused).alias("application_focused_share"),
    )


def audit_distributions(
    df: DataFrame,
    kinds: Sequence[str] = (
        "domain", "task", "source", "action", "question_type", "website_category",
    ),
) -> DataFrame:
    """Child rows of the audit: (kind, value, n)."""
    return record_profile(df).where(F.col("kind").isin(*kinds))


def value_distribution(df: DataFrame, field: str) -> DataFrame:
    return (
        df.groupBy(records.field_or(df, field).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def group_means(df: DataFrame, field: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    value = F.col(field).cast("double")
    return (
        df.where(F.col(field).isNotNull())
        .groupBy(*by, records.field_or(df, group).alias("group"))
        .agg(F.count(F.lit(1)).alias("examples"), F.sum(value).alias("total"))
        .withColumn("mean", F.col("total") / F.col("examples"))
    )


def macro_metric(df: DataFrame, field: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Micro mean and mean of group means; nulls are skipped, an empty table gives null means."""
    means = group_means(df, field, group, by)
    grouped = means.groupBy(*by) if by else means.groupBy()
    return grouped.agg(
        F.coalesce(F.sum("examples"), F.lit(0)).cast("bigint").alias("examples"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum("total") / F.sum("examples")).alias("micro"),
        F.avg("mean").alias("macro"),
    )


def split_summary(df: DataFrame) -> DataFrame:
    per_domain = df.groupBy("split", records.field_or(df, "domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_domain.groupBy("split").agg(
        F.sum("n").alias("examples"), F.count(F.lit(1)).alias("domains")
    )


def source_counts(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rows per source and split; with a design table, whether the split totals equal it."""
    counts = df.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    if expected is None:
        return counts
    totals = counts.groupBy("split").agg(F.sum("n").alias("n"))
    return expected.join(totals, "split", "full").select(
        "split",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "expected",
        F.col("n").eqNullSafe(F.col("expected")).alias("matches"),
    )


def action_counts(df: DataFrame) -> DataFrame:
    name = F.get_json_object("target_action", "$.name")
    return df.groupBy(name.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def materialization_summary(locators: DataFrame, index: DataFrame) -> DataFrame:
    """Groups, distinct images, missing ones and bytes of what is indexed: one row."""
    from agentcorpus.operators.align import locator_groups

    wanted = locators.select("locator_id").distinct()
    have = index.select("locator_id", "jpeg_bytes").dropDuplicates(["locator_id"])
    joined = wanted.join(have.withColumn("_have", F.lit(True)), "locator_id", "left")
    groups = locator_groups(locators).agg(F.count(F.lit(1)).alias("groups"))
    images = joined.agg(
        F.count(F.lit(1)).alias("unique_images"),
        F.count_if(F.col("_have").isNull()).alias("missing_images"),
        F.coalesce(F.sum("jpeg_bytes"), F.lit(0)).cast("bigint").alias("image_bytes"),
    )
    return single_row(groups, images)
