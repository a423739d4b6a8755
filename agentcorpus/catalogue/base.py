"""Registry and small helpers shared by the query modules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder beneath the shared one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def r6(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that both engines agree on the last digits."""
    return df.select(
        *[r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


# ---- SQL spelling of the stable hashes -------------------------------------------------------


def sql_key(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 16)"


def sql_mod(modulus: int, *parts: str) -> str:
    return f"((('0x' || {sql_key(*parts)})::UBIGINT % {modulus})::BIGINT)"


def sql_id(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 24)"
