"""Website catalog: one row per domain, with bounded child lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions.web import APPLICATION_CATEGORIES
from agentcorpus.operators import records
from agentcorpus.operators.ranking import first_few, ranked
from agentcorpus.session import cut

LISTS = ("surfaces", "category_rules")


def _counts(df: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """(domain, dimension, value, n) of the non-null ``pairs`` of every row, in one pass."""
    listed = F.array(
        *[F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in pairs.items()]
    )
    return (
        df.select(records.field_or(df, "domain").alias("domain"), F.explode(listed).alias("p"))
        .where("p.value is not null")
        .groupBy("domain", "p.dimension", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def catalog_dimensions(df: DataFrame, top: int = 20) -> DataFrame:
    """Child rows (domain, dimension, value, n, position).

    Surfaces and rules keep their ``top`` values, the other dimensions all.  The counts are stored
    once.  Positions come from :func:`ranked`, divided by count and the start of the value, so a
    domain with endless sources or surfaces is ranked in pieces.
    """
    action = F.get_json_object(records.optional(df, "target_action"), "$.name")
    named = F.coalesce(F.when(action != "", action), F.lit("unknown"))
    counts = cut(
        _counts(
            df,
            {
                "tasks": F.col("task"),
                "sources": records.field_or(df, "source"),
                "surfaces": records.field_or(df, "website_surface"),
                "category_votes": records.field_or(df, "website_category", "general_web"),
                "category_confidences": records.field_or(df, "website_category_confidence"),
                "category_rules": records.field_or(df, "website_category_rule"),
                "actions": F.when(F.col("task") == "action", named),
            },
        )
    )
    piece = F.struct((-F.col("n")).alias("n"), F.substring("value", 1, 3).alias("start"))
    placed = ranked(
        counts, ["domain", "dimension"], [F.desc("n"), F.col("value")], piece, "position"
    ).withColumn("position", F.col("position").cast("int"))
    return placed.where(~F.col("dimension").isin(*LISTS) | (F.col("position") <= top)).select(
        "domain", "dimension", "value", "n", "position"
    )


def website_catalog(df: DataFrame) -> DataFrame:
    """Majority category and confidence, review flag, examples and distinct units per domain.

    One pass counts units, categories and confidences per domain together, and a second, small
    aggregation of these counts gives every column.
    """
    counts = _counts(
        df,
        {
            "unit": records.sampling_unit(df),
            "category": records.field_or(df, "website_category", "general_web"),
            "confidence": records.field_or(df, "website_category_confidence", "unknown"),
        },
    )

    def of(dimension: str) -> Column:
        return F.col("dimension") == dimension

    def majority(dimension: str) -> Column:
        # Lowest (-count, name) wins: most frequent, ties in alphabetical order.
        order = F.when(of(dimension), F.struct((-F.col("n")).alias("a"), F.col("value")))
        return F.min(order)["value"]

    found = counts.groupBy("domain").agg(
        majority("category").alias("website_category"),
        majority("confidence").alias("category_confidence"),
        F.count_if(of("category")).alias("_categories"),
        F.sum(F.when(of("category"), F.col("n"))).alias("examples"),
        F.count_if(of("unit")).alias("sampling_units"),
    )
    return found.select(
        "domain",
        "website_category",
        F.col("website_category").isin(*APPLICATION_CATEGORIES).alias("application_focused"),
        "category_confidence",
        ((F.col("category_confidence") == "unknown") | (F.col("_categories") > 1)).alias(
            "manual_review_required"
        ),
        "examples",
        "sampling_units",
    )


def catalog_with_lists(catalog: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Attach the child rows as maps; each map holds at most its bounded number of entries."""
    maps = dimensions.groupBy("domain").pivot(
        "dimension", ["tasks", "sources", "surfaces", "actions", "category_votes", "category_rules"]
    ).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "value", "n"))),
                lambda e: F.struct(e["value"], e["n"]),
            )
        )
    )
    return catalog.join(maps, "domain", "left")


def dashboard_aggregate(df: DataFrame, top_surfaces: int = 8) -> dict[str, DataFrame]:
    """Task and category counts, websites, their top surfaces, and websites per category."""
    domain = records.field_or(df, "domain")
    category = records.field_or(df, "website_category", "general_web")
    websites = website_catalog(df).select(
        "domain", F.col("website_category").alias("category"),
        F.col("category_confidence").alias("confidence"), "examples",
    )
    surface = F.coalesce(
        F.when(records.optional(df, "website_surface") != "", F.col("website_surface")), domain
    )
    surfaces = first_few(
        df.groupBy(domain.alias("domain"), surface.alias("surface")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        ["domain"], [F.desc("n"), F.col("surface")], top_surfaces, "position",
    )
    return {
        "task_counts": df.groupBy(records.field_or(df, "task").alias("task")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "category_counts": df.groupBy(category.alias("category")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "websites": websites,
        "surfaces": surfaces,
        "category_websites": websites.groupBy("category").agg(
            F.count(F.lit(1)).alias("websites")
        ),
    }
