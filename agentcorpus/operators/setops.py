"""Set operations between manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus.functions import hashing
from agentcorpus.operators import records
from agentcorpus.operators.ranking import first_few
from agentcorpus.operators.rows import single_row

KINDS = ("id", "sampling_unit", "known_domain")


def _keys(df: DataFrame) -> DataFrame:
    domain = F.lower(F.btrim(F.coalesce(records.optional(df, "domain"), F.lit(""))))

    def key(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("key"))

    cells = F.array(
        key("id", F.col("id")),
        key("sampling_unit", records.sampling_unit(df)),
        key("known_domain", F.when(~domain.isin("", "unknown"), domain)),
    )
    return df.select(F.explode(cells).alias("c")).select("c.kind", "c.key").where(
        "key is not null"
    )


def leakage_keys(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Keys of either side with one flag per side: (kind, key, in_training, in_evaluation).

    Tagging and aggregating both sides together is one shuffle of distinct keys; a domain that holds
    a third of the rows is already a single row after the partial aggregate.
    """
    both = _keys(training).withColumn("t", F.lit(True)).unionByName(
        _keys(evaluation).withColumn("t", F.lit(False))
    )
    return both.groupBy("kind", "key").agg(
        F.max("t").alias("in_training"), F.max(~F.col("t")).alias("in_evaluation")
    )


def shared_keys(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Distinct keys that both sides hold: (kind, key).

    Store them where several of the checks below are made of the same two tables.
    """
    return leakage_keys(training, evaluation).where("in_training and in_evaluation").select("kind", "key")


def leakage_audit(
    training: DataFrame, evaluation: DataFrame, shared: DataFrame | None = None
) -> DataFrame:
    """Overlap counts plus row and unknown-domain counts of each side: one row."""
    shared = shared_keys(training, evaluation) if shared is None else shared
    overlap = shared.agg(
        *[F.count_if(F.col("kind") == kind).alias(f"{kind}_overlap_count") for kind in KINDS]
    )

    def side(df, name):
        unknown = F.lower(F.coalesce(records.optional(df, "domain"), F.lit(""))) == "unknown"
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_examples"),
            F.count_if(unknown).alias(f"{name}_unknown_domains"),
        )

    return single_row(overlap, side(training, "training"), side(evaluation, "evaluation"))


def leakage_preview(
    training: DataFrame, evaluation: DataFrame, rows: int = 20, shared: DataFrame | None = None
) -> DataFrame:
    shared = shared_keys(training, evaluation) if shared is None else shared
    return first_few(shared, ["kind"], [F.col("key")], rows, "position")


def required_disjoint(
    training: DataFrame, suites: DataFrame, required: Mapping[str, Sequence[str]],
    shared: DataFrame | None = None,
) -> DataFrame:
    """Suites and key kinds that must not overlap but do: (suite, kind, overlap).

    ``suites`` is one table of evaluation rows with a ``suite`` column.  A key of a suite is in training
    if it is among the keys that both tables share, where these are at hand.
    """
    unknown = sorted({k for kinds in required.values() for k in kinds} - set(KINDS))
    if unknown:
        raise ValueError(f"unknown disjoint requirements: {unknown}")
    rules = F.array(
        *[
            F.struct(F.lit(suite).alias("suite"), F.lit(kind).alias("kind"))
            for suite, kinds in required.items()
            for kind in kinds
        ]
    )
    domain = F.lower(F.btrim(F.coalesce(records.optional(suites, "domain"), F.lit(""))))
    cells = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("key")),
        F.struct(
            F.lit("sampling_unit").alias("kind"), records.sampling_unit(suites).alias("key")
        ),
        F.struct(
            F.lit("known_domain").alias("kind"),
            F.when(~domain.isin("", "unknown"), domain).alias("key"),
        ),
    )
    held = suites.select("suite", F.explode(cells).alias("c")).select(
        "suite", "c.kind", "c.key"
    ).where("key is not null")
    held = held.where(F.array_contains(rules, F.struct(F.col("suite"), F.col("kind")))).distinct()
    found = _keys(training).distinct() if shared is None else shared
    return (
        held.join(found, ["kind", "key"], "left_semi")
        .groupBy("suite", "kind")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )


def union_manifests(manifests: Mapping[str, DataFrame], label: str = "manifest") -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in manifests.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combine_tasks(parts: Mapping[str, DataFrame], seed: int) -> DataFrame:
    """Tasks of each split together, ordered by the seeded hash within the split."""
    merged = union_manifests(parts, "task_manifest")
    key = hashing.stable_key(seed, F.col("split"), F.col("id"))
    return merged.withColumn("shuffle_key", key)


def combined_tier(members: DataFrame, seed: int, max_domain_share: float) -> DataFrame:
    """Per tier over all tasks: size, top domain share, and whether the combined cap holds."""
    counts = members.groupBy("tier", "domain").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("tier").agg(
        F.sum("n").alias("examples"), F.count(F.lit(1)).alias("domains"), F.max("n").alias("_top")
    )
    share = F.col("_top") / F.col("examples")
    return totals.select(
        "tier", "examples", "domains", share.alias("max_domain_share"),
        (share <= F.lit(max_domain_share) + F.lit(1.0) / F.col("examples")).alias("cap_ok"),
    )


def combined_order(members: DataFrame, seed: int) -> DataFrame:
    return members.withColumn(
        "order_hash", hashing.stable_key(seed, F.col("tier"), "combined", F.col("id"))
    )


def nested_check(members: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ids of a tier that the next tier lacks; nested tiers give no rows."""
    flags = members.groupBy("id").agg(
        *[F.max(F.col("tier") == name).alias(f"_t{i}") for i, name in enumerate(order)]
    )
    steps = [
        F.when(F.col(f"_t{i}") & ~F.col(f"_t{i + 1}"), F.lit(order[i]))
        for i in range(len(order) - 1)
    ]
    return flags.select("id", F.explode(F.array_compact(F.array(*steps))).alias("missing_after"))


def unique_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def selected_records(parts: Sequence[DataFrame]) -> DataFrame:
    """Union where the last part that holds an id wins.

    The winner is chosen on (id, precedence) alone, inside a struct-valued aggregate, so copies of an
    id collapse before the shuffle.
    """
    tagged = [
        df.withColumn("_precedence", F.lit(i)) for i, df in enumerate(parts)
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    columns = [c for c in merged.columns if c not in ("id", "_precedence")]
    best = merged.groupBy("id").agg(
        F.max_by(F.struct(*columns), F.col("_precedence")).alias("_row")
    )
    return best.select("id", *[F.col(f"_row.{c}").alias(c) for c in columns])


def last_per_id(df: DataFrame, order: str) -> DataFrame:
    window = W.partitionBy("id").orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")
