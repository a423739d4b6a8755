"""Progress events inside mixed text logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus import schema
from agentcorpus.sources import paths


def progress_events(lines: DataFrame) -> DataFrame:
    """Everything from the first ``{`` of a line, read as an event; other lines are dropped."""
    start = F.instr("value", "{")
    body = F.when(start > 0, F.substr("value", start))
    return (
        lines.withColumn("_e", F.from_json(body, schema.PROGRESS))
        .where("_e.event is not null")
        .select(*[c for c in lines.columns if c != "value"], "_e.*")
        .withColumn("timestamp_utc", F.try_to_timestamp("timestamp_utc"))
    )


def benchmark_terminals(events: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """Last ``start`` and ``complete`` event of benchmark stages per log."""
    kept = events.where(
        F.col("event").isin("start", "complete") & F.col("stage").startswith("benchmark_")
    )
    payload = [c for c in kept.columns if c not in (*keys, "event", order)]
    last = kept.groupBy(*keys, "event").agg(
        F.max_by(F.struct(*payload), F.col(order)).alias("_l")
    )
    return last.select(*keys, "event", "_l.*")


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Terminal events per log file, by path relative to the given one; the byte position in the
    file decides which line is last."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            "value",
            paths.relative(spark, path, F.col("_metadata.file_path")).alias("log"),
            F.struct(
                F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
            ).alias("line"),
        )
    )
    return benchmark_terminals(progress_events(lines), ["log"])
