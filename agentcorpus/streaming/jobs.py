"""Streaming scores, running metrics, progress and new episodes.

All jobs run with ``availableNow`` by default: they take what has arrived, commit it and stop, and the
next run goes on from the checkpoint.  Sinks are files, never driver memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Score = Callable[[DataFrame], DataFrame]
RUN_KEYS, WINDOW = ["run_signature", "task"], "window_start"


def _start(stream: DataFrame, checkpoint: str, mode: str, sink, now: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(sink).start()


def _replace(folder: str):
    """Write each batch into its own numbered folder.

    A repeated batch after a failure overwrites its own folder, so output is written exactly once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:010d}")

    return sink


def stream_scores(
    predictions: DataFrame, score: Score, output: str, checkpoint: str, now: bool = True,
    arrival: str | None = None, delay: str = "7 days",
) -> StreamingQuery:
    """Score each (run_signature, id) once and append the scored rows.

    With an ingest-time column the remembered keys are dropped after ``delay``; without one the state
    is bounded by starting one query per run.
    """
    keys = ["run_signature", "id"]
    if arrival is None:
        once = predictions.dropDuplicates(keys)
    else:
        once = predictions.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(keys)
    return _start(score(once), checkpoint, "append", _replace(output), now)


def running_sums(scored: DataFrame, metrics: list[str], keys: list | None = None) -> DataFrame:
    return scored.groupBy(*(keys or RUN_KEYS)).agg(
        F.count(F.lit(1)).alias("examples"),
        *[F.sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(f"{m}_sum") for m in metrics],
    )


def stream_metrics(
    scored: DataFrame, metrics: list[str], output: str, checkpoint: str, now: bool = True,
    arrival: str | None = None, delay: str = "7 days", window: str | None = None,
) -> StreamingQuery:
    """Running rates per run and task; with ``window`` also per stretch of the arrival time.

    With an arrival-time column two stateful steps are chained in one query: a (run_signature, id)
    that repeats within ``delay`` counts once, rows that come later than that are left out, and ids and
    windows behind the watermark leave the state.  Without one, rows count as they come: feed the rows
    that :func:`stream_scores` has made unique.  ``update`` mode writes only the groups a batch
    touched; :func:`latest_metrics` reads the newest row of each.
    """
    if window is not None and arrival is None:
        raise ValueError("a window needs an arrival time")
    keys = [F.col(name) for name in RUN_KEYS]
    if arrival is not None:
        scored = scored.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["run_signature", "id"])
    if window is not None:
        keys.append(F.window(arrival, window).alias("_window"))
    sums = running_sums(scored, metrics, keys)
    placed = [F.col("_window.start").alias(WINDOW)] if window is not None else []
    rates = sums.select(
        *RUN_KEYS, *placed, "examples",
        *[(F.col(f"{m}_sum") / F.col("examples")).alias(m) for m in metrics],
    )
    return _start(rates, checkpoint, "update", _replace(output), now)


def _newest(df: DataFrame, keys: list[str]) -> DataFrame:
    payload = [c for c in df.columns if c not in (*keys, "batch")]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col("batch")).alias("_b"))
    return best.select(*keys, "_b.*")


def latest_metrics(df: DataFrame) -> DataFrame:
    return _newest(df, [name for name in (*RUN_KEYS, WINDOW) if name in df.columns])


def progress_state(events: DataFrame) -> DataFrame:
    """Latest completed, total, rate and remaining time per stage."""
    latest = F.max_by(
        F.struct("completed", "total", "elapsed_seconds", "timestamp_utc"),
        F.struct("timestamp_utc", "completed"),
    )
    state = events.groupBy("stage").agg(latest.alias("l")).select("stage", "l.*")
    rate = F.col("completed") / F.when(F.col("elapsed_seconds") > 0, F.col("elapsed_seconds"))
    return state.withColumn("items_per_second", rate).withColumn(
        "eta_seconds",
        F.when(
            (F.col("completed") < F.col("total")) & (F.col("items_per_second") > 0),
            (F.col("total") - F.col("completed")) / F.col("items_per_second"),
        ),
    )


def stream_progress(
    events: DataFrame, output: str, checkpoint: str, now: bool = True
) -> StreamingQuery:
    return _start(progress_state(events), checkpoint, "update", _replace(output), now)


def latest_progress(df: DataFrame) -> DataFrame:
    return _newest(df, ["stage"])


def stream_episodes(
    episodes: DataFrame, output: str, checkpoint: str, now: bool = True,
    arrival: str | None = None, delay: str = "7 days",
) -> StreamingQuery:
    """Append episodes whose id has not been seen.

    With an arrival-time column, ids are forgotten ``delay`` after the newest arrival, which bounds
    the state; without one it grows with the ids.
    """
    keys = ["episode_id"]
    if arrival is None:
        once = episodes.dropDuplicates(keys)
    else:
        once = episodes.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(keys)
    return _start(once, checkpoint, "append", _replace(output), now)
