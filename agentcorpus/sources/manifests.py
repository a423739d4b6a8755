"""Manifests, episodes, receipts, catalogs and payloads as files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus import schema
from agentcorpus.sources.paths import relative


def read_manifest(spark: SparkSession, *paths: str, columns: str = schema.RECORD) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line fails the read.

    Keys beyond ``columns`` are kept as text in the map ``extra``, which is null where there is none.
    """
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    read = lines.select(
        F.from_json("value", columns, {"mode": "FAILFAST"}).alias("_r"),
        F.from_json("value", "map<string,string>").alias("_all"),
    )
    known = list(read.select("_r.*").columns)
    extra = F.map_filter("_all", lambda key, _: ~key.isin(known))
    return read.select("_r.*", F.when(F.size(extra) > 0, extra).alias("extra"))


def write_manifest(df: DataFrame, path: str, file_format: str = "json") -> None:
    """A new folder of part files; the commit protocol makes it appear whole or not at all."""
    df.write.mode("errorifexists").format(file_format).save(path)


def write_pools(assigned: DataFrame, path: str) -> None:
    """Training and evaluation pools, one folder per destination and task.

    A destination may hold most rows, so the writer does not shuffle by it: each task writes its own
    file per folder.
    """
    assigned.where("destination is not null").write.mode("errorifexists").partitionBy(
        "destination", "task"
    ).parquet(path)


def append_episodes(episodes: DataFrame, path: str) -> None:
    episodes.write.mode("append").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file (relative) and 1-based line number.

    Lines are counted inside each split of a file; the counts of a file's earlier splits are added.
    """
    lines = spark.read.text(path).select(
        "value",
        relative(spark, path, F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    earlier = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "_start", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")
    )
    return lines.join(offsets, ["file", "_start"]).select(
        "value", "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line")
    )


def read_episodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid episodes, and the invalid lines with their file and line number."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = numbered_lines(spark, path).where(F.trim("value") != "").withColumn(
        "_e", F.from_json("value", schema.EPISODE + ", _bad string", options)
    )
    broken = F.col("_e._bad").isNotNull() | F.col("_e.episode_id").isNull()
    return read.where(~broken).select("_e.*").drop("_bad"), read.where(broken).select(
        F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("value").alias("_bad")
    )


RECEIPT_TREE = "map<string, struct<merged:struct<tasks:map<string, map<string, string>>>>>"


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts as long metrics; numeric values only, no example counts.

    A file holds one receipt, indented or not, or one per line.  Receipts are small, so a file is
    read as one value.
    """
    columns = (
        "run_id string, control string, size string, seed int, step int, model string, "
        f"model_revision string, adapter_sha256 string, suites {RECEIPT_TREE}"
    )
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda line: F.trim(line) != "")
    by_line = F.forall(lines, lambda line: F.trim(line).rlike("^[{].*[}]$"))
    texts = files.select(
        F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("value")
    )
    raw = texts.select(F.from_json("value", columns, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    head = [c for c in raw.columns if c != "suites"]
    suites = raw.select(*head, F.explode("suites").alias("suite", "_s"))
    tasks = suites.select(*head, "suite", F.explode("_s.merged.tasks").alias("task", "_t"))
    values = tasks.select(*head, "suite", "task", F.explode("_t").alias("metric", "_v"))
    return (
        values.withColumn("value", F.col("_v").try_cast("double"))
        .where("value is not null and metric <> 'examples'")
        .drop("_v")
    )


def receipts_from_metrics(metrics: DataFrame) -> DataFrame:
    """Long metrics back to one nested receipt per run.

    A receipt holds the fixed suites, tasks and metrics of one run, so the nested maps stay small.
    """
    head = [
        "run_id", "control", "size", "seed", "step", "model", "model_revision", "adapter_sha256",
    ]
    per_task = metrics.groupBy(*head, "suite", "task").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_m")
    )
    per_suite = per_task.groupBy(*head, "suite").agg(
        F.struct(
            F.struct(F.map_from_entries(F.collect_list(F.struct("task", "_m"))).alias("tasks")).alias(
                "merged"
            )
        ).alias("_s")
    )
    return per_suite.groupBy(*head).agg(
        F.map_from_entries(F.collect_list(F.struct("suite", "_s.merged"))).alias("_u")
    ).select(
        *head,
        F.transform_values("_u", lambda _, v: F.struct(v.alias("merged"))).alias("suites"),
    )


def write_catalog(catalog: DataFrame, path: str) -> DataFrame:
    """Catalog (with map columns) as JSON, and as CSV with the maps encoded; totals per category."""
    catalog.write.mode("errorifexists").json(f"{path}/json")
    kinds = dict(catalog.dtypes)
    flat = catalog.select(
        *[
            F.to_json(c).alias(c) if kinds[c].startswith("map") else F.col(c)
            for c in catalog.columns
        ]
    )
    flat.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    return catalog.groupBy("website_category").agg(
        F.count(F.lit(1)).alias("websites"),
        F.count_if("application_focused").alias("application_focused_websites"),
    )


def write_payload(parts: Mapping[str, DataFrame], path: str) -> None:
    """Dashboard payload as one table per part; nothing is nested into a single object."""
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
