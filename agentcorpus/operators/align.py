"""Joins and checks between sets of records, predictions, shards and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.operators.ranking import first_few


class CheckFailed(ValueError):
    """A consistency check found rows that violate it."""


def require_empty(violations: DataFrame, what: str, preview: int = 5) -> None:
    """Explicit check: raises with a short preview when there is any violating row."""
    rows = violations.limit(preview).collect()
    if rows:
        raise CheckFailed(f"{what}: {[row.asDict() for row in rows]}")


def duplicate_ids(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def alignment_issues(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Ids that some label lacks or holds twice: (id, label, n)."""
    counts = predictions.groupBy("id").agg(
        *[F.count_if(F.col("label") == name).alias(f"_n{i}") for i, name in enumerate(labels)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.col(f"_n{i}").alias("n"))
            for i, name in enumerate(labels)
        ]
    )
    return counts.select("id", F.explode(cells).alias("c")).select(
        "id", "c.label", "c.n"
    ).where("n <> 1")


def exactly_one(condition: Column, value: Column, what: Column) -> Column:
    """Aggregate: the value of the one row that the condition selects; none or several are an error."""
    n = F.count_if(condition)
    message = F.concat(F.lit("expected one row, found "), n.cast("string"), F.lit(": "), what)
    return F.when(n == 1, F.max(F.when(condition, value))).otherwise(F.raise_error(message))


def align_predictions(
    predictions: DataFrame, labels: Sequence[str], value: str = "prediction"
) -> DataFrame:
    """One row per id with one prediction column per label; a single shuffle for any label count.

    An id that some label lacks or holds twice is an error; :func:`alignment_issues` lists them.
    """
    return predictions.groupBy("id").agg(
        *[
            exactly_one(
                F.col("label") == name, F.col(value),
                F.concat(F.lit(f"{name} of "), F.first("id").cast("string")),
            ).alias(name)
            for name in labels
        ]
    )


def restrict_to_reference(source: DataFrame, reference: DataFrame) -> DataFrame:
    return source.join(reference.select("id"), "id", "left_semi")


def uncovered_ids(source: DataFrame, reference: DataFrame) -> DataFrame:
    return reference.select("id").join(source.select("id"), "id", "left_anti")


def resume_pending(records: DataFrame, existing: DataFrame) -> DataFrame:
    return records.join(existing.select("id"), "id", "left_anti")


def foreign_signatures(existing: DataFrame, signature: str) -> DataFrame:
    """Signatures of stored predictions that belong to another run."""
    return (
        existing.where(~F.col("run_signature").eqNullSafe(F.lit(signature)))
        .groupBy("run_signature")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _appearances(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """How often each id is expected (``e``) and predicted (``p``).

    Both sides are tagged and counted together, so the check is one aggregate and not a join.
    """
    tagged = expected.select("id", F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(
        predictions.select("id", F.lit(0).alias("e"), F.lit(1).alias("p"))
    )
    return tagged.groupBy("id").agg(F.sum("e").alias("e"), F.sum("p").alias("p"))


def _coverage_issue() -> Column:
    return (
        F.when((F.col("e") > 0) & (F.col("p") == 0), "missing")
        .when((F.col("e") == 0) & (F.col("p") > 0), "extra")
        .when(F.col("p") > 1, "duplicate")
    )


def shard_coverage(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids that are missing, extra or predicted more than once: (id, issue)."""
    counts = _appearances(expected, predictions)
    return counts.select("id", _coverage_issue().alias("issue")).where("issue is not null")


def merge_issues(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Issues of :func:`shard_coverage`, and first of all ids that are expected more than once."""
    issue = F.when(F.col("e") > 1, "not_unique").otherwise(_coverage_issue())
    counts = _appearances(expected, predictions)
    return counts.select("id", issue.alias("issue")).where("issue is not null")


def coverage_summary(issues: DataFrame, preview: int = 5) -> DataFrame:
    """Count and first ids per issue."""
    totals = issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    first = first_few(issues, ["issue"], [F.col("id")], preview).groupBy("issue").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("preview")
    )
    return totals.join(first, "issue")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def adapter_identity(adapter: Column, stage_prefix: str | None = None) -> Column:
    """Adapter path without a mount prefix that differs between environments."""
    if stage_prefix is None:
        return F.coalesce(base_name(adapter), F.lit("none"))
    parts = F.filter(F.split(adapter, "/"), lambda p: p != "")
    marks = F.transform(parts, lambda p: p.startswith(stage_prefix))
    at = F.array_position(marks, True)
    return F.when(at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")).otherwise(
        adapter
    )


IDENTITY = ("model", "model_revision", "adapter", "adapter_sha256", "manifests")


def shard_identity(shards: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Number of distinct identities per group of shards; more than one is a mismatch."""
    named = shards.withColumns(
        {
            "adapter": adapter_identity(F.col("adapter")),
            "manifests": F.array_join(F.transform("manifests", base_name), "|"),
        }
    )
    distinct = named.select(*keys, *IDENTITY).distinct()
    return distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("identities"),
        *[F.count_distinct(F.coalesce(F.col(c), F.lit(""))).alias(f"{c}_values") for c in IDENTITY],
    ).withColumn("consistent", F.col("identities") == 1)


def shard_selection_issues(shards: DataFrame) -> DataFrame:
    """Groups whose shard indices are not exactly 0 … num_shards-1."""
    return (
        shards.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("shards"),
            F.count_distinct("shard_index").alias("indices"),
            F.min("shard_index").alias("low"),
            F.max("shard_index").alias("high"),
            F.min("num_shards").alias("declared"),
            F.max("num_shards").alias("declared_high"),
        )
        .where(
            "shards <> declared or indices <> declared or low <> 0 or high <> declared - 1 "
            "or declared <> declared_high"
        )
    )


def merge_predictions(
    expected: DataFrame, predictions: DataFrame, label: str, signature: str
) -> DataFrame:
    """Predictions in manifest order, with the shard's own label and signature kept aside.

    A manifest record without a prediction is an error.
    """
    renamed = predictions.withColumnsRenamed(
        {"evaluation_label": "source_evaluation_label", "run_signature": "source_run_signature"}
    )
    found = renamed.withColumn("_found", F.lit(True))
    joined = expected.select("id", "order_key").join(found, "id", "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col("id").cast("string")))
    checked = joined.withColumn("id", F.when(F.col("_found"), F.col("id")).otherwise(missing))
    return checked.drop("_found").withColumns(
        {"evaluation_label": F.lit(label), "run_signature": F.lit(signature)}
    )


GROUP = ("dataset", "revision", "file", "row_group")


def locator_group_rows(locators: DataFrame) -> DataFrame:
    """Distinct locators with the file group they are fetched from; Arrow files have one group."""
    group = F.when(F.col("kind") == "arrow_single_image", F.lit(-1)).otherwise(F.col("row_group"))
    return locators.withColumn("row_group", group).dropDuplicates([*GROUP, "locator_id"])


def locator_groups(locators: DataFrame) -> DataFrame:
    """Distinct locators per file group.  The members stay rows; no group is collected."""
    return locator_group_rows(locators).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("locators")
    )


def trajectory_image_lookup(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolve (sample_id, screenshot) to an image position of the same trajectory row.

    ``rows`` has ``images`` (array of struct with ``path``) and ``image_paths``; a name is the
    explicit path, else the parallel path, else ``screenshot_NNN.png``.  The first image that equals
    the whole path or the base name is taken.
    """
    named = rows.select(
        "sample_id", F.posexplode("images").alias("image_index", "_image"), "image_paths"
    ).select(
        "sample_id",
        "image_index",
        F.coalesce(
            F.nullif(F.col("_image.path"), F.lit("")),
            F.nullif(F.get("image_paths", F.col("image_index")), F.lit("")),
            F.format_string("screenshot_%03d.png", F.col("image_index") + 1),
        ).alias("path"),
    ).withColumn("base", base_name(F.col("path")))
    asked = wanted.select("sample_id", "screenshot").distinct().withColumn(
        "base", base_name(F.col("screenshot"))
    )
    # A whole-path match implies a base-name match, so one equi-join finds both.
    matched = asked.join(named, ["sample_id", "base"], "left")
    return matched.groupBy("sample_id", "screenshot").agg(
        F.min("image_index").alias("image_index"), F.min_by("path", "image_index").alias("path")
    )


PICTURE = ("image", "image_width", "image_height", "jpeg_sha256", "jpeg_bytes")


def image_index_conflicts(index: DataFrame) -> DataFrame:
    """Locators whose checkpoints disagree."""
    value = F.struct(*PICTURE)
    return (
        index.select("locator_id", F.sha2(F.to_json(value), 256).alias("v"))
        .groupBy("locator_id")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .where("low <> high")
        .select("locator_id")
    )


def image_index_merge(index: DataFrame) -> DataFrame:
    """One row per locator; checkpoints that disagree about one are an error."""
    row = F.struct(*[F.col(c) for c in index.columns])
    kept = [c for c in PICTURE if c in index.columns]
    value = F.to_json(F.struct(*kept))
    merged = index.groupBy("locator_id").agg(
        F.when(F.min(value).eqNullSafe(F.max(value)), F.min(row)).otherwise(
            F.raise_error(F.concat(F.lit("image checkpoints disagree on "), F.first("locator_id")))
        ).alias("_row")
    )
    return merged.select("_row.*")


def materialize_manifest(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Records with path, dimensions, hash and size of their image."""
    picture = index.select(
        "locator_id", F.col("image").alias("image_path"), "image_width", "image_height",
        "jpeg_sha256", "jpeg_bytes",
    )
    kept = manifest.drop("image_path", "image_width", "image_height", "jpeg_sha256", "jpeg_bytes")
    return kept.join(picture, "locator_id", "left")


def store_image_index(index: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store the merged image index as table ``name`` beneath ``path``, bucketed by locator.

    Joins of manifests with the returned table (:func:`materialize_manifest`, :func:`unmaterialized`)
    shuffle the manifest only; the index, which every manifest is joined with, is shuffled once here.
    """
    (
        index.repartition(buckets, "locator_id")
        .write.bucketBy(buckets, "locator_id")
        .sortBy("locator_id")
        .option("path", path)
        .saveAsTable(name)
    )
    return index.sparkSession.table(name)


def unmaterialized(manifest: DataFrame, index: DataFrame) -> DataFrame:
    return manifest.select("locator_id").distinct().join(
        index.select("locator_id"), "locator_id", "left_anti"
    )


def pairing_issues(episodes: DataFrame, control: str, candidate: str) -> DataFrame:
    """(task_id, seed) keys that do not hold exactly one episode of each variant."""
    counts = episodes.where(F.col("variant_id").isin(control, candidate)).groupBy(
        "task_id", "seed"
    ).agg(
        F.count_if(F.col("variant_id") == control).alias("control"),
        F.count_if(F.col("variant_id") == candidate).alias("candidate"),
    )
    return counts.where("control <> 1 or candidate <> 1")


def pair_episodes(episodes: DataFrame, control: str, candidate: str) -> DataFrame:
    """Success and reward deltas per (task_id, seed): one aggregate in place of a self-join.

    A key without exactly one episode of each variant is an error; :func:`pairing_issues` lists them.
    """

    place = F.concat_ws(" ", F.first("task_id").cast("string"), F.first("seed").cast("string"))

    def of(variant, column):
        what = F.concat(F.lit(f"{variant} of "), place)
        return exactly_one(F.col("variant_id") == variant, F.col(column), what)

    pairs = episodes.where(F.col("variant_id").isin(control, candidate)).groupBy(
        "task_id", "seed"
    ).agg(
        of(control, "success").alias("_cs"), of(candidate, "success").alias("_ns"),
        of(control, "total_reward").alias("_cr"), of(candidate, "total_reward").alias("_nr"),
    )
    return pairs.select(
        "task_id", "seed",
        (F.col("_ns").cast("double") - F.col("_cs").cast("double")).alias("success_delta"),
        (F.col("_nr") - F.col("_cr")).alias("reward_delta"),
    )


def job_results(jobs: DataFrame, results: DataFrame, states: DataFrame) -> DataFrame:
    """Plan jobs with their result and training state; jobs without a result are pending."""
    return (
        jobs.join(results, "job_id", "left")
        .join(states, "job_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))
