"""Split, partition and shard assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus.functions import hashing
from agentcorpus.operators import records
from agentcorpus.operators.ranking import position_bucket, ranked
from agentcorpus.session import cut

# ---- fixed values: hash salts of the published split ----------------------------------------
DOMAIN_SALT = "exp005-domain"
IID_SALT = "exp005-iid"
# ---------------------------------------------------------------------------------------------
PARTITIONS = ("train", "domain_balanced", "distribution_shift")


def _by_share(bucket: Column, shares: Mapping[str, int]) -> Column:
    if sum(shares.values()) != 100:
        raise ValueError("percentages must total 100")
    names, chain, upto = list(shares), None, 0
    for name in names[:-1]:
        upto += shares[name]
        hit = bucket < upto
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return F.lit(names[-1]) if chain is None else chain.otherwise(F.lit(names[-1]))


def domain_split(key: Column, seed: int, shares: Mapping[str, int]) -> Column:
    return _by_share(hashing.stable_mod(100, seed, key), shares)


def split_key(domain: Column, trajectory: Column) -> Column:
    """Trajectories without a known domain are split by their own id."""
    return F.when(domain != "unknown", domain).otherwise(trajectory)


def domain_partition(domain: Column, seed: int, shares: Mapping[str, int]) -> Column:
    if tuple(shares) != PARTITIONS:
        raise ValueError(f"expected shares for {PARTITIONS}")
    return _by_share(hashing.stable_mod(100, DOMAIN_SALT, seed, domain), shares)


def unit_state(df: DataFrame, seed: int, shares: Mapping[str, int]) -> DataFrame:
    """One row per unit: number of domains, lowest and highest partition, any unknown domain.

    Minimum and maximum stand in for the set of partitions, so a unit with a third of all rows is a
    constant-size aggregate buffer.  Domains are made distinct per unit first.  Partitions are numbered in
    the order of their names, because numbers are aggregated by hash and texts by sorting.
    """
    names = F.array(*[F.lit(name) for name in sorted(shares)])
    domain = F.lower(records.field_or(df, "domain"))
    pairs = df.select("unit", domain.alias("_d")).distinct()
    part = F.when(F.col("_d") != "unknown", domain_partition(F.col("_d"), seed, shares))
    state = pairs.withColumn("_p", F.array_position(names, part).cast("int") - 1).groupBy("unit").agg(
        F.count(F.lit(1)).alias("unit_domains"),
        F.min("_p").alias("_low"),
        F.max("_p").alias("_high"),
        F.max(F.col("_d") == "unknown").alias("has_unknown"),
    )
    return state.select(
        "unit", "unit_domains", F.get(names, "_low").alias("partition_low"),
        F.get(names, "_high").alias("partition_high"), "has_unknown",
    )


def crosses_partitions() -> Column:
    return F.coalesce(
        F.col("has_unknown") | (F.col("partition_low") != F.col("partition_high")), F.lit(True)
    )


def assign_destination(
    df: DataFrame, seed: int, shares: Mapping[str, int], iid_percent: int
) -> DataFrame:
    """Add ``destination`` (null = excluded) and ``cross_partition`` to rows that carry ``unit``."""
    known_role = records.field_or(df, "source_role", "training")
    state = unit_state(df, seed, shares).withColumn(
        "cross_partition", crosses_partitions()
    ).select("unit", "partition_low", "cross_partition")
    # stored, so that both sides of the join are plain exchanges and a hot unit's rows are split
    joined = df.withColumn("_role", known_role).join(cut(state), "unit")
    part, role = F.col("partition_low"), F.col("_role")
    diverted = hashing.stable_mod(100, IID_SALT, seed, F.col("unit")) < iid_percent
    destination = (
        F.when(F.col("cross_partition"), F.lit(None))
        .when(role == "distribution_shift", F.when(part == "distribution_shift", part))
        .when(
            role != "training",
            F.raise_error(F.concat(F.lit("unknown source role: "), role)),
        )
        .when(part == "domain_balanced", part)
        .when(part == "train", F.when(diverted, F.lit("iid")).otherwise(F.lit("train")))
    )
    return joined.withColumn("destination", destination.cast("string")).drop(
        "partition_low", "_role"
    )


def unit_split_audit(
    df: DataFrame, seed: int, shares: Mapping[str, int], iid_percent: int
) -> DataFrame:
    """Units, cross-domain units, excluded units and assigned units: one row.

    A unit's rows share its partition, so its roles and its state decide whether any row is placed;
    no row is joined.
    """
    role = records.field_or(df, "source_role", "training")
    roles = df.select("unit", role.alias("_role")).groupBy("unit").agg(
        F.max(F.col("_role") == "training").alias("trains"),
        F.max(F.col("_role") == "distribution_shift").alias("shifts"),
        F.max(~F.col("_role").isin("training", "distribution_shift")).alias("_unknown"),
    )
    part = F.col("partition_low")
    placed = F.col("trains") & part.isin("train", "domain_balanced") | (
        F.col("shifts") & (part == "distribution_shift")
    )
    known = F.when(
        F.col("_unknown"), F.raise_error(F.lit("unknown source role")).cast("boolean")
    ).otherwise(placed)
    return unit_state(df, seed, shares).join(roles, "unit").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("unit_domains") > 1).alias("cross_domain_units"),
        F.count_if(crosses_partitions()).alias("excluded_cross_partition_units"),
        F.count_if(known & ~crosses_partitions()).alias("assigned_units"),
    )


def excluded_records_by_task(assigned: DataFrame) -> DataFrame:
    return (
        assigned.where(F.col("destination").isNull() & F.col("cross_partition"))
        .groupBy("task")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def destination_conflicts(assigned: DataFrame) -> DataFrame:
    """Units with two destinations, and domains that mix incompatible destinations."""
    placed = assigned.where(F.col("destination").isNotNull())
    units = (
        placed.groupBy(F.col("unit").alias("key"))
        .agg(F.min("destination").alias("low"), F.max("destination").alias("high"))
        .where("low <> high")
        .select(F.lit("unit").alias("kind"), "key", "low", "high")
    )
    family = F.when(F.col("destination").isin("train", "iid"), "train").otherwise(
        F.col("destination")
    )
    domains = (
        placed.groupBy(records.field_or(placed, "domain").alias("key"))
        .agg(F.min(family).alias("low"), F.max(family).alias("high"))
        .where("low <> high")
        .select(F.lit("domain").alias("kind"), "key", "low", "high")
    )
    return units.unionByName(domains)


def shard_by_position(
    df: DataFrame,
    manifest: str,
    order_key: str,
    num_shards: int,
    shard_index: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``position % num_shards`` per manifest; optionally one shard, optionally its first rows."""
    placed = ranked(df, [manifest], [F.col(order_key)], position_bucket(df, order_key), "position")
    placed = placed.withColumn("position", F.col("position").cast("bigint") - 1)
    placed = placed.withColumn("shard", F.pmod("position", F.lit(num_shards)).cast("int"))
    if shard_index is not None:
        placed = placed.where(F.col("shard") == shard_index)
    if limit is not None:
        # Position inside the shard is known, so the limit is a filter.
        placed = placed.where(F.floor(F.col("position") / num_shards) < limit)
    return placed


def shard_by_hash(identifier: Column, num_shards: int) -> Column:
    return hashing.digest_mod(num_shards, identifier).cast("int")


def proportional_targets(counts: DataFrame, totals: Mapping[str, int]) -> DataFrame:
    """Largest-remainder allocation of each split's total over the train counts.

    ``counts`` has ``source``, ``train`` and ``ord`` (input order breaks ties).
    """
    based = counts.withColumn("_all", counts.agg(F.sum("train")).scalar())
    pieces = F.array(
        *[
            F.struct(F.lit(split).alias("split"), F.lit(total).cast("bigint").alias("total"))
            for split, total in totals.items()
        ]
    )
    spread = based.select("*", F.explode(pieces).alias("_p")).select(
        "source", "train", "ord", "_p.split", "_p.total",
        (F.col("_p.total") * F.col("train")).alias("_scaled"), "_all",
    )
    exact = F.col("_scaled") / F.col("_all")
    whole = F.floor(exact)
    spread = spread.withColumns({"base": whole, "_rest": exact - whole})
    given = spread.groupBy("split").agg(
        (F.first("total") - F.sum("base")).alias("_left")
    )
    window = W.partitionBy("split").orderBy(F.desc("_rest"), "ord")
    return (
        spread.withColumn("_r", F.row_number().over(window))
        .join(given, "split")
        .select(
            "source", "split",
            (F.col("base") + (F.col("_r") <= F.col("_left")).cast("bigint")).alias("target"),
        )
    )


def trajectory_isolation(df: DataFrame) -> DataFrame:
    """Trajectories that occur in more than one split."""
    return (
        df.where(records.optional(df, "trajectory_id").isNotNull())
        .groupBy("trajectory_id")
        .agg(
            F.min("split").alias("first_split"),
            F.max("split").alias("last_split"),
            F.count_distinct("split").alias("splits"),
        )
        .where("splits > 1")
    )


def domain_isolation(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Domains shared by each pair of splits; an isolated corpus gives no rows.

    Each domain carries one flag per split, so no pairs of rows are ever formed.
    """
    flags = df.groupBy("domain").agg(
        *[F.max(F.col("split") == name).alias(f"_in_{i}") for i, name in enumerate(splits)]
    )
    pairs = [
        F.when(
            F.col(f"_in_{i}") & F.col(f"_in_{j}"),
            F.struct(F.lit(splits[i]).alias("left"), F.lit(splits[j]).alias("right")),
        )
        for i in range(len(splits))
        for j in range(i + 1, len(splits))
    ]
    return flags.select(
        "domain", F.explode(F.array_compact(F.array(*pairs))).alias("_p")
    ).select(F.col("_p.left").alias("left_split"), F.col("_p.right").alias("right_split"), "domain")
