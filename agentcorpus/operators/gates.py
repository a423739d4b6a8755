"""Comparisons, gates, reports and completion audits over long metrics tables.

A metrics table has one row per (run, suite, task, metric).  All gates judge every candidate run of
the table at once; a reference run is a filter, never a collected dictionary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.operators import order

# ---- fixed values: metric names, tolerances and limits ---------------------------------------
HEADLINE = (
    ("web", "qa", "answer_accuracy", True),
    ("web", "qa", "mean_token_f1", True),
    ("web", "grounding", "click_accuracy", True),
    ("web", "grounding", "median_pixel_distance", False),
    ("external", "grounding", "click_accuracy", True),
    ("external", "grounding", "median_pixel_distance", False),
)
VALIDATION = {
    "qa_answer_accuracy": 0.03,
    "grounding_click_accuracy": 0.03,
    "action_name_accuracy": 0.02,
    "click_inside_bbox_accuracy": 0.02,
}
PROGRESSION = {
    "action_name_accuracy": 0.02,
    "action_argument_accuracy": 0.03,
    "exact_action_accuracy": 0.03,
    "click_inside_bbox_accuracy": 0.02,
    "qa_answer_accuracy": 0.03,
    "grounding_click_accuracy": 0.03,
}
PROBE_HIGHER = {
    "qa_answer_accuracy": 0.03,
    "qa_mean_token_f1": 0.03,
    "grounding_click_accuracy": 0.03,
    "grounding_parse_rate": 0.03,
}
PROBE_LOWER = {"grounding_median_pixel_distance": 25.0}
PERCEPTION = (
    "iid/qa/answer_accuracy",
    "domain_balanced/qa/answer_accuracy",
    "iid/grounding/click_accuracy",
    "domain_balanced/grounding/click_accuracy",
    "distribution_shift/grounding/click_accuracy",
)
MEAN_LIMIT = -0.03
SINGLE_LIMIT = -0.075
WARNING_LIMIT = -0.03
SUITE_TASKS = {
    "iid": ("qa", "grounding", "action"),
    "domain_balanced": ("qa", "grounding", "action"),
    "distribution_shift": ("grounding", "action"),
}
RECEIPT_KINDS = {
    "job": "exp005_scaling_job_receipt",
    "training": "exp005_training_stage_receipt",
    "evaluation": "evaluation_receipt",
}
DASHBOARD_TOLERANCE = 1e-12
# ---------------------------------------------------------------------------------------------

SHA256 = "^[0-9a-f]{64}$"


def valid_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(SHA256), F.lit(False))


def metric_key() -> Column:
    return F.concat_ws("/", "suite", "task", "metric")


def metric_deltas(
    candidates: DataFrame, reference: DataFrame, keys: Sequence[str] = ("suite", "task", "metric")
) -> DataFrame:
    """Candidate minus reference for each metric both have."""
    base = reference.select(*keys, F.col("value").alias("reference_value"))
    return candidates.join(base, list(keys)).withColumn(
        "delta", F.col("value") - F.col("reference_value")
    )


def compare_metrics(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """Six headline metrics of two (benchmark, task, metric, value) tables; missing gives null."""
    spark = baseline.sparkSession
    names = spark.createDataFrame(
        HEADLINE, "benchmark string, task string, metric string, higher_is_better boolean"
    )
    keys = ["benchmark", "task", "metric"]
    joined = names.join(
        baseline.select(*keys, F.col("value").alias("baseline")), keys, "left"
    ).join(tuned.select(*keys, F.col("value").alias("tuned")), keys, "left")
    delta = F.col("tuned") - F.col("baseline")
    return joined.select(
        *keys, "baseline", "tuned", delta.alias("delta"),
        F.when(F.col("higher_is_better"), delta > 0).otherwise(delta < 0).alias("improved"),
    )


def _tolerances(spark, lower_limit: Mapping[str, float], upper_limit: Mapping[str, float] | None = None):
    rows = [(name, -float(t), None) for name, t in lower_limit.items()]
    rows += [(name, None, float(t)) for name, t in (upper_limit or {}).items()]
    return spark.createDataFrame(rows, "metric string, lowest double, highest double")


def _regressions(
    candidate: DataFrame, reference: DataFrame, rules: DataFrame, by: Sequence[str]
) -> DataFrame:
    """One row per candidate and rule with whether the drop passes the tolerance.

    The comparison is value < reference - tolerance, as written, so rounding of the difference plays
    no part.  Null metrics never regress.
    """
    base = reference.select("metric", F.col("value").alias("reference"))
    joined = candidate.select(*by, "metric", "value").join(rules, "metric").join(base, "metric")
    worse = (F.col("value") < F.col("reference") + F.col("lowest")) | F.lit(False)
    above = F.col("value") > F.col("reference") + F.col("highest")
    regressed = F.coalesce(F.when(F.col("lowest").isNotNull(), worse).otherwise(above), F.lit(False))
    return joined.withColumn("regressed", regressed)


def validation_gate(candidate: DataFrame, baseline: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = _regressions(
        candidate, baseline, _tolerances(candidate.sparkSession, VALIDATION), by
    )
    return rows.groupBy(*by).agg(
        F.count_if(F.col("regressed")).alias("regressions"),
        (~F.max("regressed")).alias("advance"),
    )


def progression_gate(
    candidate: DataFrame, selected: DataFrame, frozen: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Frozen gate and no drop beyond tolerance against the selected checkpoint."""
    rows = _regressions(
        candidate, selected, _tolerances(candidate.sparkSession, PROGRESSION), by
    )
    judged = rows.groupBy(*by).agg(
        F.count_if(F.col("regressed")).alias("regressions"),
        F.max("regressed").alias("_any"),
    )
    return judged.join(
        frozen.select(*by, F.col("advance").alias("frozen_gate_advance")), list(by)
    ).select(
        *by, "regressions", "frozen_gate_advance",
        (F.col("frozen_gate_advance") & ~F.col("_any")).alias("advance"),
    )


def probe_regressions(candidate: DataFrame, anchor: DataFrame, by: Sequence[str]) -> DataFrame:
    rules = _tolerances(candidate.sparkSession, PROBE_HIGHER, PROBE_LOWER)
    return _regressions(candidate, anchor, rules, by).where("regressed").select(
        *by, "metric", F.col("reference").alias("anchor"), F.col("value").alias("candidate")
    )


PRIMARY_PROBE = {
    "qa_answer_accuracy": ("qa", "answer_accuracy"),
    "qa_mean_token_f1": ("qa", "mean_token_f1"),
    "grounding_click_accuracy": ("grounding", "click_accuracy"),
    "grounding_parse_rate": ("grounding", "parse_rate"),
    "grounding_median_pixel_distance": ("grounding", "median_pixel_distance"),
}


def primary_probe(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Five headline values per run as columns."""

    def of(task, metric):
        hit = (F.col("task") == task) & (F.col("metric") == metric)
        return F.max(F.when(hit, F.col("value")))

    return metrics.groupBy(*by).agg(
        *[of(task, metric).alias(name) for name, (task, metric) in PRIMARY_PROBE.items()]
    )


def scaling_gate(candidates: DataFrame, reference: DataFrame, by: Sequence[str]) -> DataFrame:
    """Regression decision for every candidate run.

    A candidate that lacks one of the five perception metrics is not judged but marked
    ``missing_metrics``.
    """
    deltas = metric_deltas(candidates, reference).withColumn("key", metric_key())
    perception = F.col("key").isin(*PERCEPTION)
    action = (F.col("task") == "action") & F.col("metric").isin(
        "action_name_accuracy", "exact_action_accuracy", "click_inside_bbox_accuracy"
    )
    judged = deltas.groupBy(*by).agg(
        F.count_if(perception).alias("perception_metrics"),
        F.avg(F.when(perception, F.col("delta"))).alias("mean_perception_delta"),
        F.min_by(
            F.col("key"), F.when(perception, F.struct("delta", "key"))
        ).alias("worst_perception_metric"),
        F.min(F.when(perception, F.col("delta"))).alias("worst_perception_delta"),
        F.count_if(perception & (F.col("delta") < WARNING_LIMIT)).alias("perception_warnings"),
        F.avg(F.when(action, F.col("delta"))).alias("mean_action_delta"),
    )
    stop = (F.col("mean_perception_delta") < MEAN_LIMIT) | (
        F.col("worst_perception_delta") < SINGLE_LIMIT
    )
    return judged.withColumn(
        "decision",
        F.when(F.col("perception_metrics") < len(PERCEPTION), "missing_metrics")
        .when(stop, "stop_regression")
        .otherwise("continue"),
    )


def regression_gate(
    candidates: DataFrame,
    reference: DataFrame,
    by: Sequence[str],
    untouched: DataFrame | None = None,
) -> DataFrame:
    """:func:`scaling_gate` of candidates that are comparable, with ``delta_vs_untouched``.

    The tables carry ``model`` and ``model_revision``, candidates ``adapter_sha256`` too.  The job fails
    where a candidate has another base model than the reference, no adapter hash, or not all
    perception metrics, and where the untouched baseline has another base model.  The deltas are a map
    from metric key to candidate minus untouched value.
    """
    base = F.struct(F.col("model").alias("m"), F.col("model_revision").alias("r"))
    identity = reference.select(base.alias("i")).distinct().scalar()  # two identities are an error
    run = F.concat_ws(" ", *[F.first(name).cast("string") for name in by])

    def checked(fault: Column, message: str, value: Column) -> Column:
        return F.when(fault, F.raise_error(F.concat(F.lit(message), run))).otherwise(value)

    own = candidates.withColumn("_same", base.eqNullSafe(identity)).groupBy(*by).agg(
        checked(
            ~F.min("_same"), "another base model than the reference: ", F.first("model")
        ).alias("model"),
        F.first("model_revision").alias("model_revision"),
        checked(
            F.coalesce(F.max("adapter_sha256"), F.lit("")) == "", "no adapter hash: ", F.max("adapter_sha256")
        ).alias("adapter_sha256"),
    )
    judged = scaling_gate(candidates.select(*by, "suite", "task", "metric", "value"), reference, by)
    missing = F.raise_error(F.lit("perception metrics are missing"))
    decision = F.when(F.col("decision") == "missing_metrics", missing).otherwise(F.col("decision"))
    gate = own.join(judged.withColumn("decision", decision), list(by), "left")
    gate = gate.withColumn("decision", F.coalesce("decision", missing.cast("string")))
    if untouched is None:
        return gate
    other = untouched.select(base.alias("i")).distinct()
    same = other.agg(F.count_if(~F.col("i").eqNullSafe(identity)).alias("n")).scalar()
    deltas = metric_deltas(candidates, untouched).groupBy(*by).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(metric_key().alias("key"), F.col("delta").alias("value"))))
        ).alias("_deltas")  # a run has a fixed list of metrics
    )
    fault = F.raise_error(F.lit("the untouched baseline has another base model"))
    found = F.when(same == 0, F.col("_deltas")).otherwise(fault.cast("map<string,double>"))
    return gate.join(deltas, list(by), "left").withColumn("delta_vs_untouched", found).drop("_deltas")


def identity_issues(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """Candidate runs with another base model than the reference, or without an adapter hash."""
    # A scalar subquery: a reference with two identities is an error.
    base = reference.select(
        F.struct(F.col("model").alias("m"), F.col("model_revision").alias("r"))
    ).distinct()
    joined = runs.withColumn("_base", base.scalar()).withColumns(
        {"_m": F.col("_base.m"), "_r": F.col("_base.r")}
    )
    issue = (
        F.when(
            ~(F.col("model").eqNullSafe(F.col("_m")) & F.col("model_revision").eqNullSafe(F.col("_r"))),
            "different_base_model",
        ).when(F.coalesce("adapter_sha256", F.lit("")) == "", "adapter_hash_missing")
    )
    return joined.select("run_id", issue.alias("issue")).where("issue is not null")


def positive_result(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """(name >= .05 or click >= .10) and no perception loss beyond .03."""

    def of(metric):
        return F.max(F.when(F.col("metric") == metric, F.col("delta")))

    wide = deltas.groupBy(*by).agg(
        of("action_name_accuracy").alias("name_delta"),
        of("click_inside_bbox_accuracy").alias("click_delta"),
        of("qa_answer_accuracy").alias("qa_delta"),
        of("grounding_click_accuracy").alias("grounding_delta"),
    )
    return wide.withColumn(
        "positive_result",
        F.coalesce(
            ((F.col("name_delta") >= 0.05) | (F.col("click_delta") >= 0.10))
            & (F.col("qa_delta") >= -0.03)
            & (F.col("grounding_delta") >= -0.03),
            F.lit(False),
        ),
    )


def shard_variability(metrics: DataFrame, keys: Sequence[str], num_shards: int) -> DataFrame:
    """Mean, population deviation and range over shards; a metric some shards lack is flagged."""
    return metrics.groupBy(*keys).agg(
        F.count("value").alias("shards"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("population_std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    ).where("shards > 0").withColumn("incomplete", F.col("shards") < num_shards)


def primary_variability(
    metrics: DataFrame,
    shard: str,
    primary: Mapping[str, tuple[str, str, str]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Spread over shards of the named (suite, task, metric), a row per run and name that has values.

    Shards that disagree on whether a metric exists are an error of the job.
    """
    chain = F.lit(None).cast("string")
    for name, (suite, task, metric) in primary.items():
        hit = (F.col("suite") == suite) & (F.col("task") == task) & (F.col("metric") == metric)
        chain = F.when(hit, F.lit(name)).otherwise(chain)
    shards = F.size(F.collect_set(F.col(shard).cast("string")))  # shards of one run
    held = [
        F.struct(
            F.lit(name).alias("name"),
            F.collect_list(F.when(F.col("_name") == name, F.col("value"))).alias("values"),
        )
        for name in primary
    ]
    runs = metrics.withColumn("_name", chain).groupBy(*by).agg(
        shards.alias("num_shards"), F.array(*held).alias("_held")
    )
    each = runs.select(*by, "num_shards", F.inline("_held")).where(F.size("values") > 0)
    partial = F.raise_error(F.concat(F.lit("shards disagree on availability of "), F.col("name")))
    values = F.when(F.size("values") == F.col("num_shards"), F.col("values")).otherwise(
        partial.cast("array<double>")
    )
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
    spread = F.aggregate("values", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return (
        each.withColumn("values", values)
        .withColumn("mean", mean)
        .select(
            *by, "name", "num_shards", "mean", F.sqrt(spread / F.size("values")).alias("population_std"),
            F.array_min("values").alias("minimum"), F.array_max("values").alias("maximum"),
        )
    )


def receipt_variability(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Same with the sample deviation, which is 0 for a single value."""
    return metrics.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )


def scaling_groups(metrics: DataFrame) -> DataFrame:
    """Per (size, step) and metric: spread over seeds and runs."""
    keys = ["size", "step", "suite", "task", "metric"]
    return receipt_variability(metrics, keys)


def scaling_seeds(metrics: DataFrame) -> DataFrame:
    """Seeds of each (size, step), one row each and numbered in order."""
    return metrics.select("size", "step", "seed", "run_id").distinct()


def scaling_report(
    candidates: DataFrame, untouched: DataFrame, starting: DataFrame
) -> DataFrame:
    """Every candidate metric with its deltas against both controls."""
    keys = ["suite", "task", "metric"]
    first = untouched.select(*keys, F.col("value").alias("_u"))
    second = starting.select(*keys, F.col("value").alias("_s"))
    return (
        candidates.join(first, keys, "left")
        .join(second, keys, "left")
        .select(
            "run_id", "size", "seed", "step", *keys, "value",
            (F.col("value") - F.col("_u")).alias("delta_vs_untouched"),
            (F.col("value") - F.col("_s")).alias("delta_vs_starting_control"),
        )
    )


def registry_conflicts(registry: DataFrame) -> DataFrame:
    """Scaling identities or adapters that occur twice: (kind, key, n)."""
    identity = F.concat_ws("|", "size", F.col("seed").cast("string"), F.col("step").cast("string"))
    cells = F.array(
        F.struct(F.lit("identity").alias("kind"), identity.alias("key")),
        F.struct(F.lit("adapter").alias("kind"), F.col("adapter_sha256").alias("key")),
    )
    return (
        registry.select(F.explode(cells).alias("c"))
        .groupBy("c.kind", "c.key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def register_candidate(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Decision per incoming candidate: insert, already there, or a conflict.

    Two aggregates over the tagged union replace row-by-row lookups.
    """
    identity = ["size", "seed", "step"]
    by_identity = registry.groupBy(*identity).agg(
        F.max("adapter_sha256").alias("_adapter"), F.max("run_id").alias("_run")
    )
    by_adapter = registry.groupBy("adapter_sha256").agg(F.lit(True).alias("_taken"))
    joined = incoming.join(by_identity, identity, "left").join(by_adapter, "adapter_sha256", "left")
    same = F.col("_adapter").eqNullSafe(F.col("adapter_sha256")) & F.col("_run").eqNullSafe(
        F.col("run_id")
    )
    decision = (
        F.when(order.size_rank(F.col("size")) == 0, "unknown_size")
        .when(F.col("step") <= 0, "bad_step")
        .when(F.coalesce("adapter_sha256", F.lit("")) == "", "adapter_hash_missing")
        .when(F.col("_run").isNotNull() & same, "already_registered")
        .when(F.col("_run").isNotNull(), "identity_conflict")
        .when(F.col("_taken"), "adapter_conflict")
        .otherwise("insert")
    )
    return joined.withColumn("decision", decision).drop("_adapter", "_run", "_taken")


def dashboard_check(payload: DataFrame, receipt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of a dashboard that do not equal the receipt; empty when all agree."""
    joined = receipt.select(*keys, F.col("value").alias("receipt")).join(
        payload.select(*keys, F.col("value").alias("dashboard")), list(keys), "full"
    )
    close = F.abs(F.col("receipt") - F.col("dashboard")) <= DASHBOARD_TOLERANCE
    return joined.where(~F.coalesce(close, F.lit(False)))


def evaluation_receipt(
    terminals: DataFrame, grid: DataFrame, identities: DataFrame
) -> DataFrame:
    """Completeness of a run's suite x shard grid: one row per run and suite.

    ``grid`` lists the expected (run_id, control, suite, shard_index, num_shards); a null shard is the
    merged result.  ``terminals`` adds status, exit code and example counts.
    """
    keys = ["run_id", "suite", "shard_index"]
    right = terminals.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("control").alias("_control"),
        "status", "exit_code", "examples",
    )
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = grid.join(right, match, "left")
    done = F.coalesce(
        (F.col("status") == "complete") & (F.col("exit_code") == 0)
        & (F.col("control") == F.col("_control")),
        F.lit(False),
    )
    suites = joined.groupBy("run_id", "control", "suite").agg(
        F.count("shard_index").alias("shards"),
        F.count_if(~done).alias("incomplete"),
        F.sum(F.when(F.col("shard_index").isNotNull(), F.col("examples"))).alias("shard_examples"),
        F.sum(F.when(F.col("shard_index").isNull(), F.col("examples"))).alias("merged_examples"),
    )
    models = identities.groupBy("run_id").agg(
        F.count_distinct(
            F.struct(
                F.coalesce("model", F.lit("")), F.coalesce("model_revision", F.lit("")),
                F.coalesce("adapter", F.lit("")), F.coalesce("adapter_sha256", F.lit("")),
            )
        ).alias("model_identities"),
        F.count(F.coalesce("adapter", "adapter_sha256")).alias("_adapters"),
    )
    issue = (
        F.when(F.col("incomplete") > 0, "incomplete_grid")
        .when(~F.col("shard_examples").eqNullSafe(F.col("merged_examples")), "example_mismatch")
        .when(F.coalesce("model_identities", F.lit(0)) != 1, "identity_mismatch")
        .when((F.col("control") == "base") & (F.col("_adapters") > 0), "base_has_adapter")
        .otherwise("valid")
    )
    return suites.join(models, "run_id", "left").withColumn("verdict", issue).drop("_adapters")


def completion_issues(
    expected: DataFrame,
    jobs: DataFrame,
    job_receipts: DataFrame,
    training: DataFrame,
    evaluation: DataFrame,
    suites: DataFrame,
    shards: DataFrame,
    num_shards: int,
    kinds: Mapping[str, str] = RECEIPT_KINDS,
) -> DataFrame:
    """Issue rows (job_id, issue) of a scaling study.

    ``expected`` lists (group, size, step, seed).  Each receipt table is keyed by ``job_id``; suites
    and shards are child rows.  All of them meet in one aggregation of their tagged union by job; only
    the first owner of an adapter is looked up apart.  Every rule is one condition on a job's row.  Of
    repeated receipts of a job the greatest counts.
    """
    planned = expected.join(
        jobs.select(
            "job_id", F.col("dataset_size").alias("size"), "seed",
            F.col("total_optimizer_steps").alias("step"),
        ),
        ["size", "step", "seed"], "left",
    )
    unscheduled = planned.where("job_id is null").select(
        F.col("group").alias("job_id"),
        F.concat(F.lit("schedule lacks seed "), F.col("seed").cast("string")).alias("issue"),
    )
    selected = planned.where("job_id is not null").select("group", "job_id", "size", "step", "seed")
    hashes_ok = valid_sha256(F.col("metrics_sha256")) & valid_sha256(F.col("run_metadata_sha256"))
    suite_rows = suites.select(
        "job_id",
        F.col("suite").alias("_suite"),
        F.col("suite").isin(*SUITE_TASKS).alias("_known_suite"),
        hashes_ok.alias("_suite_hash"),
        _has_tasks().alias("_suite_has_tasks"),
    )
    per_suite = shards.groupBy("job_id", "suite").agg(
        F.count(F.lit(1)).alias("n"), *_seen_shards(num_shards),
        F.count_if(~(hashes_ok & valid_sha256(F.col("signature")))).alias("bad"),
    )
    whole = (F.col("n") == num_shards) & F.col("_every")
    shard_rows = per_suite.select("job_id", whole.alias("_whole_suite"), F.col("bad").alias("_bad_shards"))
    reuse = training.where(valid_sha256(F.col("adapter_sha256"))).groupBy("adapter_sha256").agg(
        F.min("job_id").alias("_first_owner")
    )
    plan = selected.select("job_id", F.struct("step").alias("_plan"))
    j = job_receipts.select(
        "job_id",
        F.struct(
            F.col("kind").alias("j_kind"), F.col("status").alias("j_status"), F.col("final_step").alias("j_step")
        ).alias("_j"),
    )
    t = training.select(
        "job_id",
        F.struct(
            F.col("kind").alias("t_kind"), F.col("completed_step").alias("t_step"),
            F.col("status").alias("t_status"), F.col("adapter_sha256").alias("t_adapter"),
        ).alias("_t"),
    )
    e = evaluation.select(
        "job_id",
        F.struct(
            F.col("kind").alias("e_kind"), "control", F.col("adapter_sha256").alias("e_adapter"),
            F.col("num_shards").alias("e_shards"),
        ).alias("_e"),
    )
    tagged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [plan, j, t, e, suite_rows, shard_rows]
    )
    some = F.count("_known_suite") > 0
    row = (
        tagged.groupBy("job_id")
        .agg(
            *[F.max(name).alias(name) for name in ("_plan", "_j", "_t", "_e")],
            F.size(F.collect_set("_suite")).alias("_suites"),  # a job reports a few suites
            F.count_if(~F.col("_known_suite")).alias("_odd_suites"),
            F.when(some, F.count_if(~F.col("_suite_hash"))).alias("_suite_hashes"),
            F.when(some, F.count_if(~F.col("_suite_has_tasks"))).alias("_suite_tasks"),
            F.count_if("_whole_suite").alias("_whole"),
            F.sum("_bad_shards").alias("_shard_hashes"),
        )
        .where("_plan is not null")
        .select("*", "_plan.*", "_j.*", "_t.*", "_e.*")
        .join(reuse, F.col("t_adapter") == F.col("adapter_sha256"), "left")
    )
    have = F.col("j_kind").isNotNull() & F.col("t_kind").isNotNull() & F.col("e_kind").isNotNull()

    def rule(broken, message):
        return F.when(have & F.coalesce(broken, F.lit(True)), F.lit(message))

    adapter_ok = valid_sha256(F.col("t_adapter"))
    issues = F.array_compact(
        F.array(
            F.when(~have, F.lit("missing required receipt")),
            rule(F.col("j_kind") != kinds["job"], "job result has the wrong kind"),
            rule(F.col("j_status") != "complete_pass", "job result is not complete_pass"),
            rule(F.col("j_step") != F.col("step"), "job result step differs from the schedule"),
            rule(F.col("t_kind") != kinds["training"], "training has the wrong kind"),
            rule(F.col("t_step") != F.col("step"), "training step differs from the schedule"),
            rule(F.col("t_status") != "complete_pass", "training is not complete_pass"),
            rule(~adapter_ok, "training lacks a valid adapter hash"),
            rule(F.col("e_kind") != kinds["evaluation"], "evaluation has the wrong kind"),
            rule(F.col("control") != "sft", "evaluation is not a tuned candidate"),
            rule(~valid_sha256(F.col("e_adapter")), "evaluation lacks a valid adapter hash"),
            rule(
                adapter_ok & valid_sha256(F.col("e_adapter"))
                & (F.col("t_adapter") != F.col("e_adapter")),
                "training and evaluation adapters differ",
            ),
            rule(F.col("e_shards") != num_shards, "evaluation declares another shard count"),
            rule(
                (F.coalesce("_suites", F.lit(0)) != len(SUITE_TASKS)) | (F.col("_odd_suites") > 0),
                "suite set is incomplete or unexpected",
            ),
            rule(F.col("_suite_hashes") > 0, "a suite lacks a valid hash"),
            rule(F.col("_suite_tasks") > 0, "a suite lacks required tasks"),
            rule(
                F.coalesce("_whole", F.lit(0)) != len(SUITE_TASKS),
                "shard indices are incomplete or duplicated",
            ),
            rule(F.col("_shard_hashes") > 0, "a shard lacks a valid hash"),
            rule(adapter_ok & (F.col("_first_owner") != F.col("job_id")), "adapter hash is reused"),
        )
    )
    found = row.select("job_id", F.explode(issues).alias("issue"))
    return found.unionByName(unscheduled)


def _seen_shards(num_shards: int) -> list[Column]:
    """Aggregate: whether every index from 0 to ``num_shards`` - 1 occurs.

    Up to 62 indices are bits of one number, which needs no shuffle of distinct indices.
    """
    index = F.col("shard_index")
    if num_shards > 62:
        inside = F.when(index.between(0, num_shards - 1), index)
        return [(F.count_distinct(inside) == num_shards).alias("_every")]
    bits = [F.when(index == i, F.lit(1 << i).cast("bigint")) for i in range(num_shards)]
    seen = F.bit_or(F.coalesce(*bits, F.lit(0).cast("bigint")))
    return [(seen == F.lit((1 << num_shards) - 1).cast("bigint")).alias("_every")]


def _has_tasks() -> Column:
    """Whether a suite's ``tasks`` array holds every task the suite must report."""
    chain = None
    for suite, tasks in SUITE_TASKS.items():
        needed = F.array(*[F.lit(t) for t in tasks])
        ok = F.size(F.array_except(needed, F.coalesce("tasks", F.array().cast("array<string>")))) == 0
        chain = F.when(F.col("suite") == suite, ok) if chain is None else chain.when(
            F.col("suite") == suite, ok
        )
    return chain.otherwise(F.lit(True))


def completion_audit(selected_jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """Status per job: complete, invalid or incomplete."""
    counts = issues.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("issues"),
        F.max(F.col("issue") == "missing required receipt").alias("_missing"),
    )
    status = (
        F.when(F.col("issues").isNull(), "complete")
        .when(F.col("_missing"), "incomplete")
        .otherwise("invalid")
    )
    return selected_jobs.join(counts, "job_id", "left").select(
        *selected_jobs.columns, status.alias("status"),
        F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues"),
    )


def reproducibility_gate(
    reference: DataFrame, candidate: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Row counts and order-free content fingerprints of each named table of two runs.

    Both inputs hold ``file`` and a canonical ``line``; equal fingerprints and counts mean equal
    content.
    """
    from agentcorpus.sources.checksums import row_fingerprint

    def side(df, name):
        return df.where(F.col("file").isin(*names)).groupBy("file").agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            row_fingerprint(F.col("line")).alias(f"{name}_fingerprint"),
        )

    both = side(reference, "reference").join(side(candidate, "candidate"), "file", "full")
    same = F.col("reference_fingerprint").eqNullSafe(F.col("candidate_fingerprint")) & F.col(
        "reference_rows"
    ).eqNullSafe(F.col("candidate_rows"))
    return both.withColumn("exact_match", same)


def runtime_comparison(events: DataFrame, created: DataFrame) -> DataFrame:
    """Setup, evaluation and wall seconds of each run from its start and complete events."""
    joined = events.join(created, "run_id")

    def at(event, column):
        return F.max(F.when(F.col("event") == event, F.col(column)))

    per_run = joined.groupBy("run_id", "created").agg(
        at("start", "timestamp_utc").alias("_s"), at("complete", "timestamp_utc").alias("_c"),
        at("complete", "elapsed_seconds").alias("evaluation_seconds"),
    )

    def seconds(a, b):
        return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 1e6

    return per_run.select(
        "run_id", seconds("created", "_s").alias("setup_seconds"), "evaluation_seconds",
        seconds("created", "_c").alias("wall_seconds"),
    )
