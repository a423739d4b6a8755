"""Row numbers, first-k selections and medians that no hot group can overload.

A plain ``row_number()`` puts a whole group into one task.  Here every group is first divided by an
order-preserving bucket (leading digits of a hash, a position range, a value range): rows are ranked
inside (group, bucket) and the sizes of the earlier buckets are added.  The answer is the same as
the plain window, but a group that holds a third of the table spreads over all of its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus.session import cut


BUCKET, OFFSET, SIZE = "_bucket", "_offset", "_size"




def bucket_offsets(
    df: DataFrame, keys: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Rows (or summed weight) in all earlier buckets of the same group.

    One row per (group, bucket): partial aggregation shrinks it before the shuffle, and the running
    sum works on at most the number of buckets per group.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(*keys, BUCKET).agg(amount.cast("bigint").alias(SIZE))
    ordered = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    running = ordered.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn(OFFSET, F.coalesce(F.sum(SIZE).over(running), F.lit(0)))


def _join_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [*keys, BUCKET]
    right = offsets.select(
        *[F.col(name).alias(f"_o{i}") for i, name in enumerate(names)], OFFSET
    )
    condition = F.lit(True)
    for i, name in enumerate(names):
        condition = condition & F.col(name).eqNullSafe(F.col(f"_o{i}"))
    return df.join(right, condition).drop(*[f"_o{i}" for i in range(len(names))])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    out: str = "rank",
    limit: int | None = None,
) -> DataFrame:
    """1-based row number within ``keys`` along ``order``; optionally only ranks up to ``limit``.

    ``bucket`` must never decrease along ``order``.  With a limit, buckets that start beyond it are
    dropped before any row is sorted.
    """
    bucketed = df.withColumn(BUCKET, bucket)
    offsets = bucket_offsets(bucketed, keys)
    if limit is not None:
        offsets = offsets.where(F.col(OFFSET) < limit)
    joined = _join_offsets(bucketed, offsets, keys)
    local = W.partitionBy(*keys, BUCKET).orderBy(*order)
    numbered = joined.withColumn(out, F.row_number().over(local) + F.col(OFFSET)).drop(
        BUCKET, OFFSET
    )
    return numbered if limit is None else numbered.where(F.col(out) <= limit)


SALTS = 16
MEDIAN_STEPS = 2048  # buckets per doubling of a value


def first_few(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, out: str = "rank"
) -> DataFrame:
    """First ``limit`` rows per group, whatever the limit.

    Every group is first divided by the partition its rows lie in, and each part keeps its own first
    ``limit`` rows, so that a hot group is sorted in parts and only the rows that can still be among
    the first meet.  For large limits with an order-preserving bucket use :func:`ranked`.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn(out, F.row_number().over(part)).where(F.col(out) <= limit)
    window = W.partitionBy(*keys).orderBy(*order)
    return kept.drop("_salt").withColumn(out, F.row_number().over(window)).where(F.col(out) <= limit)


def displayed(df: DataFrame, order: Sequence[Column], limit: int | None, out: str) -> DataFrame:
    """Rows with their 1-based rank along ``order``, the first ``limit`` only where one is given.

    The rank is kept as a column because a later join does not keep the order of rows.  Rows are
    sorted by range and stored; each partition's offset comes from the partition sizes.
    """
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    stored = cut(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, F.col("_before") + inside + 1)
        .drop("_part", "_place", "_before")
    )


def position_bucket(df: DataFrame, column: str, buckets: int = 1024) -> Column:
    """Equal-count bucket of a position, whatever its distribution.

    The bounds are quantiles from a fixed-size summary of all rows; a row finds its bucket by binary
    search in them.
    """
    steps = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, steps, 20 * buckets)).first()[0]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>")
    halvings = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, halvings)),
        F.lit(-1),
        lambda at, step: F.when(F.get(listed, at + step) <= F.col(column), at + step).otherwise(at),
    )


def take_lowest(
    df: DataFrame, value: str, high: float, tie: str, count: int, out: str = "rank",
    buckets: int = 65536,
) -> DataFrame:
    """The ``count`` rows with the lowest (value, tie), for values in (0, high].

    ``tie`` is a hash text.  A histogram over equal-width value buckets locates the cut; rows beyond
    it are dropped, and each remaining bucket is ranked on its own, divided further by value and
    leading hash digits so that many equal values do not meet in one task.  ``df`` is read several
    times: pass a stored table.
    """
    coarse = F.floor(F.col(value) / F.lit(float(high)) * F.lit(buckets - 1)).cast("bigint")
    table = df.withColumn(BUCKET, coarse)
    starts = bucket_offsets(table, []).where(F.col(OFFSET) < count).select(
        F.col(BUCKET).alias("_coarse"), F.col(OFFSET).alias("_start")
    )
    kept = table.withColumnRenamed(BUCKET, "_coarse").join(starts, "_coarse")
    fine = F.struct(F.col(value), F.substring(tie, 1, 2))
    inside = ranked(kept, ["_coarse"], [F.col(value), F.col(tie)], fine, out)
    return (
        inside.withColumn(out, F.col(out) + F.col("_start"))
        .where(F.col(out) <= count)
        .drop("_coarse", "_start")
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str, width: float = 1.0,
    weight: str | None = None,
) -> DataFrame:
    """Exact median per group of non-negative values; the mean of the middle two for even counts.

    Equal values collapse in the partial aggregate, so neither a hot group nor a hot value reaches
    one task whole; only the bucket(s) holding the middle are sorted.  Buckets grow with the value,
    so none is open-ended.  With ``weight`` a row stands for that many equal values.
    """
    amount = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    counted = df.groupBy(*keys, value).agg(amount.alias("_n")).where("_n > 0")
    bucketed = counted.withColumn(
        BUCKET, F.floor(F.log2(F.col(value) / F.lit(width) + 1) * MEDIAN_STEPS).cast("bigint")
    )
    offsets = bucket_offsets(bucketed, keys, "_n")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = offsets.withColumn("_total", F.sum(SIZE).over(whole))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = [
        (F.col(OFFSET) <= at) & (at < F.col(OFFSET) + F.col(SIZE)) for at in (low, high)
    ]
    middle = offsets.where(holds[0] | holds[1]).withColumn("_lo", low).withColumn("_hi", high)
    names = [*keys, BUCKET]
    right = middle.select(
        *[F.col(name).alias(f"_o{i}") for i, name in enumerate(names)], OFFSET, "_lo", "_hi"
    )
    condition = F.lit(True)
    for i, name in enumerate(names):
        condition = condition & F.col(name).eqNullSafe(F.col(f"_o{i}"))
    inside = bucketed.join(right, condition)
    run = W.partitionBy(*keys, BUCKET).orderBy(value)
    upto = F.sum("_n").over(run.rowsBetween(W.unboundedPreceding, 0)) + F.col(OFFSET)
    marked = inside.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(position):
        hit = (F.col("_start") <= F.col(position)) & (F.col(position) < F.col("_end"))
        return F.max(F.when(hit, F.col(value)))

    grouped = marked.groupBy(*keys) if keys else marked.groupBy()
    return grouped.agg(((at("_lo") + at("_hi")) / 2.0).alias(out))


