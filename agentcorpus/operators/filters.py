"""Filters, rejections and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.operators import records
from agentcorpus.operators.align import require_empty


def exclude_domains(df: DataFrame, domains: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows outside the configured domains, and the dropped rows counted per domain."""
    listed = [d.lower() for d in domains]
    domain = F.lower(records.field_or(df, "domain"))
    hit = domain.isin(*listed) if listed else F.lit(False)
    dropped = df.where(hit).groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return df.where(~hit), dropped


def contaminated(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    return df.where(F.col("source").isin(*sources)).groupBy("source").agg(
        F.count(F.lit(1)).alias("n")
    )


def exclude_sources(df: DataFrame, sources: Sequence[str]) -> None:
    """Explicit check: a contaminated source is an error, not a filter."""
    require_empty(contaminated(df, sources), "contaminated source present")


def unknown_domains(df: DataFrame) -> DataFrame:
    return df.where(records.field_or(df, "domain") == "unknown")


def reject_unknown_domains(df: DataFrame) -> None:
    require_empty(unknown_domains(df).select("id"), "unknown domains remain")


def source_label_check(df: DataFrame, manifest: str = "manifest_source") -> DataFrame:
    """Rows whose label is not that of the manifest they came from, counted."""
    return (
        df.where(~F.col("source").eqNullSafe(F.col(manifest)))
        .groupBy(manifest, "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def contains_text(needle: str, *fields: Column) -> Column:
    """Case-insensitive containment over the joined fields; a blank needle matches everything."""
    wanted = needle.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(wanted))


def status_filter(status: str, correct: Column) -> Column:
    if status == "all":
        return F.lit(True)
    if status in ("hit", "recovered"):
        return correct
    if status in ("miss", "still-wrong"):
        return ~correct
    raise ValueError(f"unknown status: {status}")


def facet_search(
    df: DataFrame, needle: str, fields: Sequence[str], facets: dict[str, str] | None = None,
    status: str = "all", correct: str | None = None,
) -> DataFrame:
    """Text search over ``fields`` and equality on each facet that is not ``all``."""
    condition = contains_text(needle, *[F.col(f) for f in fields])
    for name, value in (facets or {}).items():
        if value != "all":
            condition = condition & (F.col(name) == value)
    if correct is not None:
        condition = condition & status_filter(status, F.coalesce(F.col(correct), F.lit(False)))
    return df.where(condition)


def website_search(df: DataFrame, needle: str, maps: Sequence[str], category: str = "all") -> DataFrame:
    """Websites by domain or by a key of their surface or source maps."""
    keys = [F.array_join(F.map_keys(m), " ") for m in maps]
    condition = contains_text(needle, F.col("domain"), *keys)
    if category != "all":
        condition = condition & (F.col("category") == category)
    return df.where(condition)


def image_path_violations(df: DataFrame, column: str = "image") -> DataFrame:
    """Distinct paths that are absolute, leave their folder or lie outside ``images/``."""
    stripped = required_images(df, column)
    path = F.col("image")
    safe = path.startswith("images/") & ~path.rlike("(^|/)\\.\\.(/|$)")
    return stripped.where(~F.coalesce(safe, F.lit(False)))


def required_images(df: DataFrame, column: str = "image") -> DataFrame:
    return df.select(F.regexp_replace(F.col(column), "^/", "").alias("image")).distinct()
