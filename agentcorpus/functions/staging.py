"""Columns that are computed once per row, whatever later steps do with them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns behind a one-element generator.

    A projection alone does not hold an expensive column: a later filter on it is pushed below and
    repeats the expression in every place, and a chain of such steps grows without bound.  A filter
    on a generator's output stays where it is, and projections do not merge across it.  The columns are
    computed in a projection before it, where common parts are found once; inside the generator they
    would not be.
    """
    fields = F.struct(*[column.alias(name) for name, column in columns.items()])
    made = df.select("*", fields.alias("_made"))
    held = made.select(*df.columns, F.explode_outer(F.array("_made")).alias("_staged"))
    return held.withColumns({name: F.col(f"_staged.{name}") for name in columns}).drop("_staged")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it.

    ``use`` is evaluated without generated code, which keeps long and rarely taken branches out of
    methods that would then be too long for the JVM to compile.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
