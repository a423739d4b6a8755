"""Streaming jobs over the given files, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, rounded, scratch, sql_mod
from agentcorpus.functions import hashing
from agentcorpus.operators import score
from agentcorpus.session import cut
from agentcorpus.streaming import jobs


def _stream(spark, folder, name):
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A stream source wants a folder or a pattern; this pattern names the one file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _finish(started):
    started.awaitTermination()


@query(
    "stream_scores",
    f"""WITH {B.GROUNDING_SQL} SELECT id, benchmark AS run_signature, parse_success,
        within_element_bounds FROM g""",
)
def stream_scores(spark, folder):
    """Every prediction arrives twice and is scored once."""
    predictions = B.grounding_predictions_of(_stream(spark, folder, "lineitem")).withColumn(
        "run_signature", F.col("benchmark")
    )
    twice = predictions.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy")).drop("_copy")
    out = scratch(spark, "stream-scores")
    arriving = twice.withColumn("arrived", F.current_timestamp())
    names = ["id", "run_signature", "parse_success", "within_element_bounds"]

    def scored(rows):  # other columns are neither shuffled nor written
        return score.grounding_score(rows).select(names)

    _finish(jobs.stream_scores(arriving, scored, f"{out}/rows", f"{out}/state", arrival="arrived"))
    return spark.read.parquet(f"{out}/rows").select(names)


@query(
    "stream_metrics",
    f"""WITH {B.GROUNDING_SQL} SELECT benchmark AS run_signature, 'grounding' AS task,
        count(*)::BIGINT AS examples, round(avg(parse_success::INT::DOUBLE), 6) AS parse_success,
        round(avg(within_element_bounds::INT::DOUBLE), 6) AS within_element_bounds
        FROM g GROUP BY benchmark""",
)
def stream_metrics(spark, folder):
    scored = score.grounding_score(
        B.grounding_predictions_of(_stream(spark, folder, "lineitem"))
    ).withColumn("run_signature", F.col("benchmark"))
    out = scratch(spark, "stream-metrics")
    _finish(
        jobs.stream_metrics(
            scored, ["parse_success", "within_element_bounds"], f"{out}/rows", f"{out}/state"
        )
    )
    return rounded(jobs.latest_metrics(spark.read.parquet(f"{out}/rows")))


_DAY = sql_mod(10, "id")
_FIRST_DAY = 20000
_COPIED = f"""copied AS (SELECT *, {_DAY} AS day FROM g UNION ALL
    SELECT * REPLACE ('extra:' || id AS id), {_DAY} FROM g WHERE {_DAY} = 8)"""


@query(
    "stream_window_metrics",
    f"""WITH {B.GROUNDING_SQL}, {_COPIED}
    SELECT benchmark AS run_signature, 'grounding' AS task, day, count(*)::BIGINT AS examples,
      round(avg(parse_success::INT::DOUBLE), 6) AS parse_success,
      round(avg(within_element_bounds::INT::DOUBLE), 6) AS within_element_bounds
    FROM copied GROUP BY benchmark, day""",
)
def stream_window_metrics(spark, folder):
    """Three arrivals of predictions on ten days: days 0 to 7; all of these again with days 8 and 9;
    then new ids, those of day 8 in time and those of days 0 to 5 behind the watermark."""
    given = score.grounding_score(B.grounding_predictions(spark, folder)).withColumns(
        {"run_signature": F.col("benchmark"), "day": hashing.stable_mod(10, F.col("id"))}
    )
    given = given.withColumn("arrived", F.timestamp_seconds((F.col("day") + _FIRST_DAY) * 86400))
    given = cut(  # three arrivals read the scores
        given, "id", "task", "run_signature", "day", "arrived", "parse_success", "within_element_bounds"
    )
    fresh = given.withColumn(
        "id", F.concat(F.when(F.col("day") == 8, "extra:").otherwise("late:"), F.col("id"))
    )
    arrivals = [given.where("day < 8"), given, fresh.where("day <= 5 or day = 8")]
    source, out = scratch(spark, "stream-arrivals"), scratch(spark, "stream-windows")
    for rows in arrivals:  # each run takes what has arrived and goes on from the checkpoint
        rows.drop("day").write.mode("append").parquet(source)
        _finish(
            jobs.stream_metrics(
                spark.readStream.schema(given.drop("day").schema).parquet(source),
                ["parse_success", "within_element_bounds"], f"{out}/rows", f"{out}/state",
                arrival="arrived", delay="3 days", window="1 day",
            )
        )
    found = jobs.latest_metrics(spark.read.parquet(f"{out}/rows"))
    day = F.expr(f"unix_seconds({jobs.WINDOW}) div 86400 - {_FIRST_DAY}").alias("day")
    return rounded(
        found.select(
            "run_signature", "task", day, "examples", "parse_success", "within_element_bounds"
        )
    )


@query(
    "stream_progress",
    """SELECT event_type AS stage, arg_max(event_id, (ts, event_id))::BIGINT AS completed
       FROM events GROUP BY event_type""",
)
def stream_progress(spark, folder):
    events = _stream(spark, folder, "events").select(
        F.col("event_type").alias("stage"), F.col("event_id").alias("completed"),
        F.lit(1000000).cast("bigint").alias("total"), F.col("value").alias("elapsed_seconds"),
        F.col("ts").alias("timestamp_utc"),
    )
    out = scratch(spark, "stream-progress")
    _finish(jobs.stream_progress(events, f"{out}/rows", f"{out}/state"))
    return jobs.latest_progress(spark.read.parquet(f"{out}/rows")).select("stage", "completed")


@query(
    "stream_episodes",
    "SELECT DISTINCT user_id::VARCHAR AS episode_id FROM events",
)
def stream_episodes(spark, folder):
    episodes = _stream(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("ts").cast("timestamp").alias("ts"),
    )
    out = scratch(spark, "stream-episodes")
    _finish(
        jobs.stream_episodes(
            episodes, f"{out}/rows", f"{out}/state", arrival="ts", delay="3650 days"
        )
    )
    return spark.read.parquet(f"{out}/rows").select("episode_id")
