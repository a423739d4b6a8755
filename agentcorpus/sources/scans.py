"""Scans of raw trajectory and screenshot sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from agentcorpus.operators import expand
from agentcorpus.sources.paths import relative


def file_position(df: DataFrame, path: str, dataset: str, revision: str) -> DataFrame:
    """Locator columns: file name relative to the given path, byte offset of the split, and row index in the file.

    The start of the split stands in for the row-group number: both name one contiguous piece of one
    file, which is what later fetches group by.
    """
    return df.withColumns(
        {
            "dataset": F.lit(dataset),
            "revision": F.lit(revision),
            "file": relative(df.sparkSession, path, F.col("_metadata.file_path")),
            "row_group": F.col("_metadata.file_block_start"),
            "row_index": F.col("_metadata.row_index"),
        }
    )


def scan_trajectories(
    spark: SparkSession, path: str, dataset: str = "", revision: str = ""
) -> DataFrame:
    """Only the three text columns are read; image bytes never leave the file."""
    raw = file_position(spark.read.parquet(path), path, dataset, revision)
    return raw.select(
        "sample_id", "instruction", "trajectory", "dataset", "revision", "file", "row_group",
        "row_index",
    )


def scan_screenshots(
    spark: SparkSession, path: str, dataset: str = "", revision: str = ""
) -> DataFrame:
    raw = file_position(spark.read.parquet(path), path, dataset, revision)
    return raw.select(
        "messages", "metadata", "dataset", "revision", "file", "row_group", "row_index"
    )


def rejected_trajectories(df: DataFrame) -> DataFrame:
    """Parsed rows with a status column: null for usable, else the reason."""
    parsed = expand.parse_trajectories(df)
    return parsed.withColumn("reason", expand.trajectory_status(parsed))


REASONS = ("malformed_row", "no_valid_examples")


def write_scanned(df: DataFrame, path: str, reasons: Sequence[str] = REASONS) -> dict[str, int]:
    """Write the rows without a ``reason`` as Parquet and count the others in the same pass.

    Counts of rows, accepted rows, every known reason and all ``other`` ones; what is counted is what
    the one write saw, so no second scan can disagree with it.
    """
    seen = Observation()
    known = {name: F.count_if(F.col("reason") == name) for name in reasons}
    other = F.count_if(F.col("reason").isNotNull() & ~F.col("reason").isin(*reasons))
    counts = {"rows": F.count(F.lit(1)), "accepted": F.count_if(F.col("reason").isNull()), **known, "other": other}
    observed = df.observe(seen, *[value.alias(name) for name, value in counts.items()])
    observed.where(F.col("reason").isNull()).drop("reason").write.parquet(path)
    return dict(seen.get)


def rejection_summary(df: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Rejections per source and reason."""
    return df.where("reason is not null").groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def scan_summary(df: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejected")
    )


def scan_completeness(expected: DataFrame, scans: DataFrame) -> DataFrame:
    """Pinned files without a complete scan of the same identity; must be empty before a freeze."""
    done = scans.select("file", "complete", F.col("identity").alias("_found"))
    return expected.join(done, "file", "left").where(
        ~F.coalesce(F.col("complete"), F.lit(False)) | ~F.col("identity").eqNullSafe(F.col("_found"))
    ).select("file", "identity", F.col("_found").alias("scanned_identity"))


def shuffled_source(spark: SparkSession, path: str, key: Sequence, columns: Mapping | None = None):
    """A seeded global order in place of a buffer shuffle."""
    from agentcorpus.operators.sample import seeded_shuffle

    df = spark.read.parquet(path)
    return seeded_shuffle(df.withColumns(dict(columns)) if columns else df, *key)
