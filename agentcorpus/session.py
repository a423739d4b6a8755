"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "agentcorpus", **settings) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    A folder of our own is used only where the setting is missing, as in a local test session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="agentcorpus-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *columns: str) -> DataFrame:
    """Write rows (of the named columns, where given) as Parquet in the shared folder; read them back.

    They are computed once and survive lost executors; later steps prune columns, and the shuffle
    files behind them are let go.
    """
    return cut_in_turn([df], *columns)


def cut_in_turn(parts: Sequence[DataFrame], *columns: str, codec: str | None = None) -> DataFrame:
    """:func:`cut` of the rows of all parts, which have one schema, written one part after another.

    The shuffle files of a part are let go before the next one starts, so those of one part lie on disk
    at a time.  ``codec`` is the session's unless given.
    """
    spark = parts[0].sparkSession
    kept = [df.select(*columns) if columns else df for df in parts]
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        for df in kept:
            df.write.parquet(path, mode="append", compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(kept[0].schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work on a small input all cores.

    An input with fewer splits than cores is small by construction and is redistributed by key.  A
    large one already has more splits than cores and is left where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
