"""Written intermediates and global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus.session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write rows as Parquet beneath the shared folder and read them back.

    Later steps start from files that every executor sees: a lost executor costs a reread, and the
    rows are computed once however often they are used.  The shuffle files behind them are let go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """Add a gapless 0-based row number along ``order`` without any single-task sort.

    Rows are range-partitioned and sorted, stored with their place inside the partition, and the
    partition sizes (one row per partition) give each partition's offset.
    """
    placed = stored(
        df.repartitionByRange(partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftrightunsigned("_place", 33)
    earlier = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(out, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_place", "_before")
    )


def text_key(text: Column) -> Column:
    """128 hash bits of a text; equal texts have equal keys."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], spread: Column, ways: int = 32) -> DataFrame:
    """Left join of ``found``, unique on ``keys``, to rows of which many may share a key.

    ``found`` is repeated once per way and a row goes the way that its ``spread`` hash names, so the
    rows of a hot key are dealt out to ``ways`` tasks.  Rows with a null key find nothing.

    The join is a sort-merge join at any size: Spark's estimate of the repeated rows leaves the ways out,
    and a broadcast chosen by it would gather ``ways`` times the rows on the driver.
    """
    way = F.pmod(spread, F.lit(ways)).cast("int")
    ways_of = found.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return rows.withColumn("_way", way).join(ways_of.hint("merge"), [*keys, "_way"], "left").drop("_way")
