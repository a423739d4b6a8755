"""Paired studies of logged episodes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions import hashing
from agentcorpus.operators.rows import single_row

# ---- fixed values: default reward weights ----------------------------------------------------
REWARD_WEIGHTS = {
    "action_validity": 0.05,
    "progress": 0.2,
    "task_success": 1.0,
    "action_error": -0.1,
    "parse_error": -0.1,
}
# ---------------------------------------------------------------------------------------------


def reward_weights(overrides: Mapping[str, float] | None = None) -> dict[str, float]:
    weights = dict(REWARD_WEIGHTS)
    for name, value in (overrides or {}).items():
        if name not in weights:
            raise ValueError(f"unknown reward weight: {name}")
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"reward weight {name} must be numeric")
        weights[name] = float(value)
    return weights


def reward_components(signals: Column, weights: Mapping[str, float] = REWARD_WEIGHTS) -> Column:
    """Struct of one component per signal and their total; an unknown signal is an error."""
    names = sorted(weights)
    unknown = F.filter(F.map_keys(signals), lambda k: ~k.isin(*names))
    parts = {
        name: F.coalesce(F.try_element_at(signals, F.lit(name)), F.lit(0.0)) * F.lit(weights[name])
        for name in names
    }
    total = F.lit(0.0)
    for name in names:
        total = total + parts[name]
    checked = F.when(
        F.coalesce(F.size(unknown), F.lit(0)) > 0,
        F.raise_error(F.concat(F.lit("unknown reward signals: "), F.array_join(unknown, ","))).cast(
            "double"
        ),
    ).otherwise(total)
    return F.struct(*[parts[n].alias(n) for n in names], checked.alias("reward"))


def episode_steps(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", "variant_id", F.explode("steps").alias("s")).select(
        "episode_id", "variant_id", "s.*"
    )


def episode_rollup(steps: DataFrame) -> DataFrame:
    """Steps taken, success of the last step, total reward and parse errors per episode."""
    return steps.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("steps_taken"),
        F.coalesce(F.max_by("success", "step_index"), F.lit(False)).alias("success"),
        F.sum("reward").alias("total_reward"),
        F.count("parse_error").alias("parse_errors"),
    )


def variant_summary(episodes: DataFrame) -> DataFrame:
    hit = F.coalesce("success", F.lit(False))
    steps = F.sum("steps_taken")
    return episodes.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(hit).alias("successes"),
        F.avg(hit.cast("double")).alias("success_rate"),
        F.avg("total_reward").alias("mean_reward"),
        F.avg("steps_taken").alias("mean_steps"),
        F.coalesce(
            F.sum("parse_errors") / F.when(steps > 0, steps), F.lit(0.0)
        ).alias("parse_error_rate"),
    )


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("paired_episodes"),
        F.coalesce(F.avg("success_delta"), F.lit(0.0)).alias("success_rate_delta"),
        F.coalesce(F.avg("reward_delta"), F.lit(0.0)).alias("mean_reward_delta"),
    )


IDENTITY = ("study_id", "run_id", "suite_id", "config_sha256")


def shard_identity(manifests: DataFrame) -> DataFrame:
    """One row (the identity and ``merged_shards``) of shard manifests that make one whole run.

    The job fails where there are no manifests, one is not complete, the shard numbers are not 0 to
    ``num_shards`` - 1 once each, or manifests disagree on study, run, suite or configuration.
    """
    n, shards = F.count(F.lit(1)), F.max("num_shards")
    numbers = (
        (n == shards)
        & (F.min("num_shards") == shards)
        & (F.count_distinct("shard_index") == n)
        & (F.min("shard_index") == 0)
        & (F.max("shard_index") == n - 1)
    )
    agree = F.lit(True)
    for name in IDENTITY:
        agree = agree & (F.count(name) == n) & (F.min(name) == F.max(name))
    fault = (
        F.when(n == 0, "no study shard manifests")
        .when(F.count_if(F.col("status") == "complete") < n, "all study shards must be complete")
        .when(~F.coalesce(numbers, F.lit(False)), "study shards are missing or repeated")
        .when(~agree, "study shards disagree on study, run, suite or configuration")
    )
    found = manifests.agg(fault.alias("_fault"), *[F.max(c).alias(c) for c in IDENTITY], n.alias("merged_shards"))
    checked = F.when(F.col("_fault").isNull(), F.col("merged_shards")).otherwise(F.raise_error(F.col("_fault")))
    return found.withColumn("merged_shards", checked).drop("_fault")


def merge_shards(manifests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes of all shards as those of one run, with ``merged_shards``.

    One aggregate by (variant, episode) makes a repeated episode id an error, and the identity of the
    shards is read by the same job: whatever is computed from the rows fails with it.
    """
    row = F.struct(*[F.col(c) for c in episodes.columns])
    what = F.concat_ws(" ", F.lit("duplicate episode"), F.first("variant_id"), F.first("episode_id"))
    once = episodes.groupBy("variant_id", "episode_id").agg(
        F.when(F.count(F.lit(1)) == 1, F.any_value(row)).otherwise(F.raise_error(what)).alias("_row")
    )
    shards = shard_identity(manifests).select("merged_shards").scalar()
    return once.select("_row.*", shards.alias("merged_shards")).where("merged_shards > 0")


def compare_variants(
    episodes: DataFrame, control: str, candidates: Sequence[str], samples: int = 2000, seed: int = 0
) -> DataFrame:
    """Paired comparison of every candidate variant with the control, a row per candidate."""
    from agentcorpus.operators.align import pair_episodes

    rows = [
        paired_bootstrap(pair_episodes(episodes, control, name), samples, seed).select(
            F.lit(name).alias("variant_id"), F.lit(control).alias("control"), "*"
        )
        for name in candidates
    ]
    return reduce(DataFrame.unionByName, rows)


def bootstrap_positions(samples: int) -> tuple[int, int]:
    """0-based positions of the interval ends among the sorted estimates."""
    return int(0.025 * (samples - 1)), int(0.975 * (samples - 1))


def paired_bootstrap(pairs: DataFrame, samples: int = 2000, seed: int = 0) -> DataFrame:
    """Mean deltas with a 95 % bootstrap interval of the success delta: one row.

    A success delta is -1, 0 or 1, so resampling n pairs with replacement is one multinomial draw over
    three counts.  The pairs are first reduced to those counts; ``samples`` draws are then spread over
    the cluster, each seeded by its own number.  The cost does not depend on n.
    """
    spark = pairs.sparkSession
    counts = pairs.agg(
        F.struct(
            F.count_if(F.col("success_delta") < 0).alias("minus"),
            F.count_if(F.col("success_delta") == 0).alias("zero"),
            F.count_if(F.col("success_delta") > 0).alias("plus"),
        )
    )
    draws = spark.range(samples).withColumn("_c", counts.scalar())

    def resample(batches):
        for batch in batches:
            estimates = []
            for draw, minus, zero, plus in zip(
                batch["id"], batch["minus"], batch["zero"], batch["plus"]
            ):
                total = int(minus + zero + plus)
                if total == 0:
                    estimates.append(0.0)
                    continue
                rng = np.random.default_rng([seed, int(draw)])
                got = rng.multinomial(total, np.array([minus, zero, plus]) / total)
                estimates.append(float(got[2] - got[0]) / total)
            yield pd.DataFrame({"estimate": estimates})

    estimates = draws.select("id", "_c.minus", "_c.zero", "_c.plus").mapInPandas(
        resample, "estimate double"
    )
    low, high = bootstrap_positions(samples)
    # The estimates number ``samples``, a parameter, whatever the size of the data.
    ordered = F.array_sort(F.collect_list("estimate"))
    interval = estimates.agg(ordered.alias("_e")).select(
        F.col("_e")[low].alias("ci_low"), F.col("_e")[high].alias("ci_high")
    )
    return single_row(pair_summary(pairs), interval)


DIGITS = 4  # hex digits of a digest behind one weight
WEIGHTS_PER_DIGEST = 64 // DIGITS


def poisson_steps() -> list[int]:
    """Distribution function of a Poisson variable of mean one in steps of 16 ** -DIGITS.

    A uniform number of DIGITS hex digits has as many steps at or below it as the variable's value.
    """
    scale, steps, total, term = 16**DIGITS, [], 0.0, math.exp(-1.0)
    while round(scale * (total + term)) < scale:
        total += term
        steps.append(round(scale * total))
        term /= len(steps)
    return steps


def clustered_bootstrap(
    rows: DataFrame, cluster: str, value: str, samples: int = 200, seed: int = 0
) -> DataFrame:
    """Mean of ``value`` with a 95 % interval from resampling whole clusters: one row.

    Every cluster has, in every sample, a Poisson weight of mean one, read from a hash of (seed,
    cluster), so a sample needs no draw by number and no join.  Clusters are reduced to (sum, n) by the
    only shuffle of data; the sums of all samples are then merged from one partial row per task and
    sample.  Samples in which all weights are zero have no estimate and do not count.
    """
    totals = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(
        F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    name = F.coalesce(F.concat(F.lit("="), F.col("cluster").cast("string")), F.lit("null"))
    blocks = -(-samples // WEIGHTS_PER_DIGEST)
    block = F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))).alias("block")
    hashed = totals.select("s", "n", block, name.alias("name")).withColumn(
        "digest", hashing.digest("poisson", seed, F.col("name"), F.col("block"))
    )
    steps = F.array(*map(F.lit, poisson_steps()))

    def weight(at: Column) -> Column:
        digits = F.col("digest").substr(at * DIGITS + 1, F.lit(DIGITS))
        number = F.conv(digits, 16, 10).cast("int")
        drawn = F.size(F.filter(steps, lambda step: step <= number))
        return F.struct(
            (F.col("block") * WEIGHTS_PER_DIGEST + at).alias("sample"), drawn.alias("weight")
        )

    # sample -1 holds every cluster once: the mean itself
    every = F.array(F.struct(F.lit(-1).alias("sample"), F.lit(1).alias("weight")))
    weights = F.transform(F.sequence(F.lit(0), F.lit(WEIGHTS_PER_DIGEST - 1)), weight)
    drawn = hashed.select("s", "n", F.inline(F.when(F.col("block") < 0, every).otherwise(weights)))
    sums = drawn.where(F.col("sample") < samples).groupBy("sample").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum(F.col("s") * F.col("weight")).alias("s"),
        F.sum(F.col("n") * F.col("weight")).alias("n"),
    )
    estimate = F.col("s") / F.when(F.col("n") > 0, F.col("n"))
    whole = F.col("sample") < 0
    found = sums.agg(
        F.coalesce(F.max(F.when(whole, F.col("clusters"))), F.lit(0).cast("bigint")).alias("clusters"),
        F.max(F.when(whole, estimate)).alias("mean"),
        F.array_sort(F.collect_list(F.when(~whole, estimate))).alias("_e"),  # one number per sample
    )
    last = (F.size("_e") - 1).cast("double")
    ends = [F.get("_e", F.floor(last * share).cast("int")) for share in (0.025, 0.975)]
    return found.select("clusters", "mean", ends[0].alias("ci_low"), ends[1].alias("ci_high"))


def episode_id(variant: Column, task: Column, seed: Column) -> Column:
    return F.substring(
        hashing.digest(variant, task, seed, separator="\x00"), 1, 20
    )
