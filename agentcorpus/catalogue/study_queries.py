"""Paired episodes, roll-ups, rewards and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, r6, rounded, scratch, table
from agentcorpus.operators.rows import single_row
from agentcorpus.operators import align, study


def _steps(spark, folder):
    """Conversation turns as episode steps."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("episode_id"),
        F.col("turn").alias("step_index"),
        (F.col("role") == "assistant").alias("success"),
        (F.length("text") / 1000.0).alias("reward"),
        F.when(F.length("text") % 5 == 0, "invalid").alias("parse_error"),
    )


@query(
    "episode_rollup",
    """SELECT conv_id::VARCHAR AS episode_id, count(*)::BIGINT AS steps_taken,
       arg_max(role, turn) = 'assistant' AS success,
       round(sum(length(text) / 1000.0::DOUBLE), 6) AS total_reward,
       count(*) FILTER (length(text) % 5 = 0)::BIGINT AS parse_errors
       FROM conversations GROUP BY conv_id""",
)
def episode_rollup(spark, folder):
    return rounded(study.episode_rollup(_steps(spark, folder)))


@query(
    "variant_summary",
    f"""WITH e AS ({B.EPISODES_SQL}) SELECT variant_id, count(*)::BIGINT AS episodes,
        count(*) FILTER (success)::BIGINT AS successes,
        round(avg(success::INT::DOUBLE), 6) AS success_rate,
        round(avg(total_reward), 6) AS mean_reward, round(avg(steps_taken), 6) AS mean_steps,
        round(sum(parse_errors)::DOUBLE / sum(steps_taken), 6) AS parse_error_rate
        FROM e GROUP BY variant_id""",
)
def variant_summary(spark, folder):
    return rounded(study.variant_summary(B.paired_episodes(spark, folder)))


_STUDY_SHARDS = 5


@query(
    "study_merge",
    f"""WITH e AS ({B.EPISODES_SQL}) SELECT variant_id, {_STUDY_SHARDS}::BIGINT AS merged_shards,
        count(*)::BIGINT AS episodes, count(*) FILTER (success)::BIGINT AS successes,
        round(avg(success::INT::DOUBLE), 6) AS success_rate,
        round(avg(total_reward), 6) AS mean_reward, round(avg(steps_taken), 6) AS mean_steps,
        round(sum(parse_errors)::DOUBLE / sum(steps_taken), 6) AS parse_error_rate
        FROM e GROUP BY variant_id""",
)
def study_merge(spark, folder):
    """Episodes written by shard, with a manifest each; the merged summary is that of the whole run."""
    path, order = scratch(spark, "study"), F.col("o_custkey") % _STUDY_SHARDS
    episodes = B.paired_episodes(spark, folder).withColumns(
        {
            "episode_id": study.episode_id(F.col("variant_id"), F.col("task_id"), F.col("seed")),
            "shard_index": order.cast("int"),
        }
    )
    episodes.write.partitionBy("shard_index").parquet(f"{path}/episodes")
    written = spark.read.parquet(f"{path}/episodes")
    constants = {"study_id": "s", "run_id": "r", "suite_id": "t", "config_sha256": "c", "status": "complete"}
    written.groupBy("shard_index").agg(
        F.lit(_STUDY_SHARDS).alias("num_shards"),
        *[F.lit(value).alias(name) for name, value in constants.items()],
    ).write.json(f"{path}/manifests")
    kinds = "shard_index int, num_shards int, " + ", ".join(f"{name} string" for name in constants)
    shards = spark.read.schema(kinds).json(f"{path}/manifests")
    merged = study.merge_shards(shards, written.drop("shard_index"))
    summary = study.variant_summary(merged).withColumn(
        "merged_shards", study.shard_identity(shards).select("merged_shards").scalar()
    )
    return rounded(summary)


_PAIRS = f"""e AS ({B.EPISODES_SQL}), p AS (SELECT c.task_id, c.seed, c.o_custkey,
  n.success::INT::DOUBLE - c.success::INT::DOUBLE AS success_delta,
  n.total_reward - c.total_reward AS reward_delta FROM e c JOIN e n USING (task_id, seed)
  WHERE c.variant_id = 'control' AND n.variant_id = 'candidate')"""


def _pairs(spark, folder):
    return align.pair_episodes(B.paired_episodes(spark, folder), "control", "candidate")


@query(
    "pair_episodes",
    f"WITH {_PAIRS} SELECT task_id, seed, success_delta, round(reward_delta, 6) AS reward_delta FROM p",
)
def pair_episodes(spark, folder):
    return rounded(_pairs(spark, folder))


@query(
    "pair_summary",
    f"""WITH {_PAIRS} SELECT count(*)::BIGINT AS paired_episodes,
        round(avg(success_delta), 6) AS success_rate_delta,
        round(avg(reward_delta), 6) AS mean_reward_delta FROM p""",
)
def pair_summary(spark, folder):
    return rounded(study.pair_summary(_pairs(spark, folder)))


@query(
    "pairing_issues",
    """SELECT o_orderpriority AS task_id, 0::INT AS seed, count(*) FILTER (o_orderstatus = 'F')::BIGINT
         AS control, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS candidate FROM orders
       GROUP BY o_orderpriority""",
)
def pairing_issues(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("task_id"), F.lit(0).alias("seed"),
        F.when(F.col("o_orderstatus") == "F", "control").when(
            F.col("o_orderstatus") == "O", "candidate"
        ).otherwise("other").alias("variant_id"),
    )
    return align.pairing_issues(rows, "control", "candidate")


_TOLERANCE = 0.3  # of the interval's half width, between 1000 resamples and the normal interval


@query(
    "paired_bootstrap",
    f"""WITH {_PAIRS} SELECT count(*)::BIGINT AS paired_episodes,
        round(avg(success_delta), 6) AS success_rate_delta,
        round(avg(reward_delta), 6) AS mean_reward_delta,
        round(avg(success_delta) - 1.96::DOUBLE * stddev_pop(success_delta) / sqrt(count(*)), 6) AS normal_low,
        round(avg(success_delta) + 1.96::DOUBLE * stddev_pop(success_delta) / sqrt(count(*)), 6) AS normal_high,
        true AS agrees FROM p""",
)
def paired_bootstrap(spark, folder):
    """Counts and deltas, and whether the resampled interval agrees with the normal one."""
    pairs = _pairs(spark, folder)
    spread = pairs.agg(
        (F.stddev_pop("success_delta") / F.sqrt(F.count("success_delta"))).alias("error")
    )
    found = single_row(study.paired_bootstrap(pairs, samples=1000, seed=B.SEED), spread)
    half = F.lit(1.96) * F.col("error")
    low, high = F.col("success_rate_delta") - half, F.col("success_rate_delta") + half
    near = (F.abs(F.col("ci_low") - low) <= _TOLERANCE * half) & (
        F.abs(F.col("ci_high") - high) <= _TOLERANCE * half
    )
    return rounded(
        found.select(
            "paired_episodes", "success_rate_delta", "mean_reward_delta", low.alias("normal_low"),
            high.alias("normal_high"), near.alias("agrees"),
        )
    )


_SAMPLES = 200


@query(
    "clustered_bootstrap",
    f"""WITH t AS (SELECT doc_id % 97 AS cluster, sum(quality)::DOUBLE AS s, count(quality) AS n
          FROM labels WHERE quality IS NOT NULL GROUP BY ALL),
    w AS (SELECT b, s, n, len([x FOR x IN {study.poisson_steps()} IF x <= ('0x' || substr(sha256(
        concat_ws(chr(31), 'poisson', '{B.SEED}', '=' || cluster::VARCHAR, (b // 16)::VARCHAR)),
        (b % 16 * 4 + 1)::BIGINT, 4))::INTEGER]) AS weight FROM range({_SAMPLES}) x(b), t),
    e AS (SELECT b, sum(s * weight) / sum(n * weight) AS estimate FROM w GROUP BY b
          HAVING sum(n * weight) > 0),
    o AS (SELECT list(estimate ORDER BY estimate) AS l FROM e)
    SELECT (SELECT count(*) FROM t)::BIGINT AS clusters, round((SELECT sum(s) / sum(n) FROM t), 6) AS mean,
      round(l[floor((len(l) - 1) * 0.025::DOUBLE)::BIGINT + 1], 6) AS ci_low,
      round(l[floor((len(l) - 1) * 0.975::DOUBLE)::BIGINT + 1], 6) AS ci_high FROM o""",
)
def clustered_bootstrap(spark, folder):
    labels = table(spark, folder, "labels").withColumn("cluster", F.col("doc_id") % 97)
    return rounded(
        study.clustered_bootstrap(labels, "cluster", "quality", samples=_SAMPLES, seed=B.SEED)
    )


@query(
    "reward_components",
    """SELECT event_id, round(value / 10 * 0.2::DOUBLE, 6) AS progress,
       round(0.05::DOUBLE + value / 10 * 0.2::DOUBLE + CASE WHEN event_type = 'error'
         THEN -0.1::DOUBLE ELSE 0 END, 6) AS reward FROM events""",
)
def reward_components(spark, folder):
    events = table(spark, folder, "events")
    signals = F.create_map(
        F.lit("action_validity"), F.lit(1.0),
        F.lit("progress"), F.col("value") / 10,
        F.lit("action_error"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0),
    )
    parts = events.select("event_id", study.reward_components(signals).alias("r"))
    return parts.select(
        "event_id", r6("r.progress").alias("progress"), r6("r.reward").alias("reward")
    )


@query(
    "episode_id",
    """SELECT o_orderkey, substr(sha256(concat_ws(chr(1), 'control', o_orderkey::VARCHAR, '7')), 1, 20)
       AS ascii_id FROM orders""",
)
def episode_id(spark, folder):
    """SQL text cannot hold the zero separator, so the twin uses another one; tests check the real."""
    from agentcorpus.functions.hashing import digest

    orders = table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        F.substring(digest("control", F.col("o_orderkey"), 7, separator="\x01"), 1, 20).alias(
            "ascii_id"
        ),
    )
