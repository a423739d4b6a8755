"""Comparisons, gates, reports and audits; every supplier of lineitem is a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, r6, rounded, table
from agentcorpus.operators import gates, order

KEYS = ["suite", "task", "metric"]
_C = f"c AS ({B.CANDIDATES_SQL}), b AS ({B.CONTROL_SQL})"
_DELTA = f"""{_C}, d AS (SELECT c.*, c.value - b.value AS delta, b.value AS ref,
  c.suite || '/' || c.task || '/' || c.metric AS key FROM c JOIN b USING (suite, task, metric))"""


@query(
    "metric_delta_join",
    f"WITH {_DELTA} SELECT run_id, suite, task, metric, round(delta, 6) AS delta FROM d",
)
def metric_delta_join(spark, folder):
    rows = gates.metric_deltas(B.candidate_metrics(spark, folder), B.control_metrics(spark, folder))
    return rows.select("run_id", *KEYS, r6("delta").alias("delta"))


_PERCEPTION = ", ".join(f"'{k}'" for k in gates.PERCEPTION)


@query(
    "scaling_gate",
    f"""WITH {_DELTA}, g AS (SELECT run_id, count(*) FILTER (key IN ({_PERCEPTION}))::BIGINT
        AS perception_metrics,
      avg(delta) FILTER (key IN ({_PERCEPTION})) AS mean_d,
      min(delta) FILTER (key IN ({_PERCEPTION})) AS worst_d,
      count(*) FILTER (key IN ({_PERCEPTION}) AND delta < -0.03)::BIGINT AS perception_warnings,
      avg(delta) FILTER (task = 'action' AND metric IN ('action_name_accuracy',
        'exact_action_accuracy', 'click_inside_bbox_accuracy')) AS action_d FROM d GROUP BY run_id)
    SELECT run_id, perception_metrics, round(mean_d, 6) AS mean_perception_delta,
      round(worst_d, 6) AS worst_perception_delta, perception_warnings,
      round(action_d, 6) AS mean_action_delta, CASE WHEN perception_metrics < 5 THEN 'missing_metrics'
        WHEN mean_d < -0.03 OR worst_d < -0.075 THEN 'stop_regression' ELSE 'continue' END AS decision
    FROM g""",
)
def scaling_gate(spark, folder):
    judged = gates.scaling_gate(
        B.candidate_metrics(spark, folder), B.control_metrics(spark, folder), ["run_id"]
    )
    return rounded(judged.drop("worst_perception_metric"))


@query(
    "regression_gate",
    f"""WITH {_DELTA}, g AS (SELECT run_id, avg(delta) FILTER (key IN ({_PERCEPTION})) AS mean_d,
      min(delta) FILTER (key IN ({_PERCEPTION})) AS worst_d FROM d GROUP BY run_id
      HAVING count(*) FILTER (key IN ({_PERCEPTION})) = 5)
    SELECT d.run_id, sha256(d.run_id) AS adapter_sha256, key, round(value - ref / 2, 6) AS delta_vs_untouched,
      CASE WHEN mean_d < -0.03 OR worst_d < -0.075 THEN 'stop_regression' ELSE 'continue' END AS decision
    FROM d JOIN g USING (run_id)""",
)
def regression_gate(spark, folder):
    """Runs with all perception metrics, judged and compared with an untouched baseline."""
    identity = {"model": F.lit("base"), "model_revision": F.lit("r1")}
    control = B.control_metrics(spark, folder).withColumns(identity)
    metrics = B.candidate_metrics(spark, folder).withColumns(identity)
    whole = gates.scaling_gate(metrics, control, ["run_id"]).where("decision <> 'missing_metrics'")
    judged = gates.regression_gate(
        metrics.join(whole.select("run_id"), "run_id", "left_semi"), control, ["run_id"],
        control.withColumn("value", F.col("value") / 2),
    )
    rows = judged.select(
        "run_id", "adapter_sha256", "decision", F.explode("delta_vs_untouched").alias("key", "delta_vs_untouched")
    )
    return rounded(rows)


@query(
    "scaling_report",
    f"""WITH {_C} SELECT run_id, size, seed, step, suite, task, metric, round(c.value, 6) AS value,
        round(c.value - b.value, 6) AS delta_vs_untouched,
        round(c.value - h.value, 6) AS delta_vs_starting_control
        FROM c JOIN b USING (suite, task, metric) JOIN (SELECT suite, task, metric, value / 2 AS value
          FROM b) h USING (suite, task, metric)""",
)
def scaling_report(spark, folder):
    control = B.control_metrics(spark, folder)
    starting = control.withColumn("value", F.col("value") / 2)
    return rounded(gates.scaling_report(B.candidate_metrics(spark, folder), control, starting))


@query(
    "scaling_groups",
    f"""WITH {_C} SELECT size, step, suite, task, metric, count(*)::BIGINT AS runs,
        round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS sample_std,
        round(min(value), 6) AS minimum, round(max(value), 6) AS maximum FROM c GROUP BY ALL""",
)
def scaling_groups(spark, folder):
    return rounded(gates.scaling_groups(B.candidate_metrics(spark, folder)))


@query(
    "receipt_variability",
    f"""WITH {_C} SELECT seed, task, metric, count(*)::BIGINT AS runs, round(avg(value), 6) AS mean,
        round(coalesce(stddev_samp(value), 0.0), 6) AS sample_std, round(min(value), 6) AS minimum,
        round(max(value), 6) AS maximum FROM c GROUP BY ALL""",
)
def receipt_variability(spark, folder):
    return rounded(
        gates.receipt_variability(B.candidate_metrics(spark, folder), ["seed", "task", "metric"])
    )


@query(
    "shard_variability",
    f"""WITH {_C} SELECT run_id, task, metric, count(value)::BIGINT AS shards,
        round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS population_std,
        round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
        count(value) < 3 AS incomplete FROM c GROUP BY ALL""",
)
def shard_variability(spark, folder):
    """Suites taken as the three shards of a run."""
    rows = gates.shard_variability(
        B.candidate_metrics(spark, folder), ["run_id", "task", "metric"], 3
    )
    return rounded(rows)


_PRIMARY = {"answers": ("all", "qa", "answer_accuracy"), "clicks": ("all", "grounding", "click_accuracy")}


@query(
    "primary_variability",
    f"""WITH {_C}, k AS (SELECT *, CASE task WHEN 'qa' THEN 'answers' ELSE 'clicks' END AS name FROM c
      WHERE (task = 'qa' AND metric = 'answer_accuracy') OR (task = 'grounding' AND metric = 'click_accuracy')),
    w AS (SELECT run_id FROM c GROUP BY run_id HAVING count(DISTINCT suite) = (SELECT count(DISTINCT suite) FROM c))
    SELECT run_id, name, count(*)::INTEGER AS num_shards, round(avg(value), 6) AS mean,
      round(stddev_pop(value), 6) AS population_std, round(min(value), 6) AS minimum,
      round(max(value), 6) AS maximum FROM k SEMI JOIN w USING (run_id) GROUP BY run_id, name""",
)
def primary_variability(spark, folder):
    """Suites taken as the shards of a run, for runs that have all of them."""
    metrics = B.candidate_metrics(spark, folder)
    every = metrics.agg(F.count_distinct("suite")).scalar()
    whole = metrics.groupBy("run_id").agg(F.count_distinct("suite").alias("n")).where(F.col("n") == every)
    rows = metrics.join(whole.select("run_id"), "run_id", "left_semi").select(
        "run_id", F.col("suite").alias("shard"), F.lit("all").alias("suite"), "task", "metric", "value"
    )
    return rounded(gates.primary_variability(rows, "shard", _PRIMARY, ["run_id"]))


_PROBE_CASE = " ".join(
    f"WHEN task = '{task}' AND metric = '{metric}' THEN '{name}'"
    for name, (task, metric) in gates.PRIMARY_PROBE.items()
)
_PROBE_COLUMNS = ", ".join(
    f"round(max(value) FILTER (task = '{task}' AND metric = '{metric}'), 6) AS {name}"
    for name, (task, metric) in gates.PRIMARY_PROBE.items()
)


@query(
    "primary_probe",
    f"WITH {_C} SELECT run_id, suite, {_PROBE_COLUMNS} FROM c GROUP BY run_id, suite",
)
def primary_probe(spark, folder):
    return rounded(
        gates.primary_probe(B.candidate_metrics(spark, folder), ["run_id", "suite"])
    )


def _named(df):
    """Long metrics under the flat names the early gates use, for the iid suite's tasks."""
    name = F.lit(None).cast("string")
    pairs = {
        ("qa", "answer_accuracy"): "qa_answer_accuracy",
        ("qa", "mean_token_f1"): "qa_mean_token_f1",
        ("grounding", "click_accuracy"): "grounding_click_accuracy",
        ("grounding", "parse_rate"): "grounding_parse_rate",
        ("grounding", "median_pixel_distance"): "grounding_median_pixel_distance",
    }
    for (task, metric), flat in pairs.items():
        name = F.when((F.col("task") == task) & (F.col("metric") == metric), flat).otherwise(name)
    name = F.when(F.col("task") == "action", F.col("metric")).otherwise(name)
    return df.withColumn("metric", name)


_NAMED = f"CASE WHEN task = 'action' THEN metric {_PROBE_CASE} END"


def _rules(values: dict, sign: str = "-") -> str:
    return ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in values.items())


def _suite_control(spark, folder):
    """Average of the control over its suites, one value per metric."""
    return _named(B.control_metrics(spark, folder)).groupBy("metric").agg(
        F.avg("value").alias("value")
    )


def _suite_candidates(spark, folder):
    rows = _named(B.candidate_metrics(spark, folder))
    return rows.groupBy("run_id", "metric").agg(F.avg("value").alias("value"))


_FLAT = f"""{_C}, cn AS (SELECT run_id, {_NAMED} AS metric, avg(value) AS value FROM c GROUP BY 1, 2),
bn AS (SELECT {_NAMED} AS metric, avg(value) AS ref FROM b GROUP BY 1)"""
_VALIDATION = f"""{_FLAT}, v AS (SELECT run_id, metric, value < ref - t AS bad FROM cn
  JOIN bn USING (metric) JOIN (VALUES {_rules(gates.VALIDATION)}) r(metric, t) USING (metric)),
vg AS (SELECT run_id, count(*) FILTER (bad)::BIGINT AS regressions, NOT max(bad) AS advance
  FROM v GROUP BY run_id)"""


@query("validation_gate", f"WITH {_VALIDATION} SELECT run_id, regressions, advance FROM vg")
def validation_gate(spark, folder):
    return gates.validation_gate(
        _suite_candidates(spark, folder), _suite_control(spark, folder), ["run_id"]
    )


@query(
    "progression_gate",
    f"""WITH {_VALIDATION}, p AS (SELECT run_id, metric, value < ref * 0.99 - t AS bad FROM cn
      JOIN bn USING (metric) JOIN (VALUES {_rules(gates.PROGRESSION)}) r(metric, t) USING (metric))
    SELECT run_id, count(*) FILTER (bad)::BIGINT AS regressions,
      any_value(vg.advance) AS frozen_gate_advance, any_value(vg.advance) AND NOT max(bad) AS advance
    FROM p JOIN vg USING (run_id) GROUP BY run_id""",
)
def progression_gate(spark, folder):
    candidates, control = _suite_candidates(spark, folder), _suite_control(spark, folder)
    frozen = gates.validation_gate(candidates, control, ["run_id"])
    selected = control.withColumn("value", F.col("value") * 0.99)
    return gates.progression_gate(candidates, selected, frozen, ["run_id"])


@query(
    "probe_regressions",
    f"""WITH {_FLAT} SELECT run_id, metric, round(ref, 6) AS anchor, round(value, 6) AS candidate
      FROM cn JOIN bn USING (metric) JOIN (VALUES {_rules(gates.PROBE_HIGHER)}) r(metric, t)
        USING (metric) WHERE value < ref - t
    UNION ALL SELECT run_id, metric, round(ref, 6), round(value, 6) FROM cn JOIN bn USING (metric)
      WHERE metric = 'grounding_median_pixel_distance' AND value > ref + 25.0""",
)
def probe_regressions(spark, folder):
    return rounded(
        gates.probe_regressions(
            _suite_candidates(spark, folder), _suite_control(spark, folder), ["run_id"]
        )
    )


_P = "max(value - ref) FILTER (metric = '{0}')"


@query(
    "positive_result",
    f"""WITH {_FLAT}, w AS (SELECT run_id, {_P.format('action_name_accuracy')} AS n,
      {_P.format('click_inside_bbox_accuracy')} AS k, {_P.format('qa_answer_accuracy')} AS q,
      {_P.format('grounding_click_accuracy')} AS g FROM cn JOIN bn USING (metric) GROUP BY run_id)
    SELECT run_id, (n >= 0.05 OR k >= 0.10) AND q >= -0.03 AND g >= -0.03 AS positive_result FROM w""",
)
def positive_result(spark, folder):
    deltas = gates.metric_deltas(
        _suite_candidates(spark, folder), _suite_control(spark, folder), ["metric"]
    )
    return gates.positive_result(deltas, ["run_id"]).select("run_id", "positive_result")


def _two_benchmarks(spark, folder, status):
    line = table(spark, folder, "lineitem").where(F.col("l_linestatus") == status)
    bench = F.when(F.col("l_returnflag") == "A", "web").otherwise("external")
    wide = line.groupBy(bench.alias("benchmark")).agg(
        F.avg((F.col("l_discount") > 0.05).cast("double")).alias("qa/answer_accuracy"),
        F.avg("l_discount").alias("qa/mean_token_f1"),
        F.avg((F.col("l_quantity") > 25).cast("double")).alias("grounding/click_accuracy"),
        F.avg("l_quantity").alias("grounding/median_pixel_distance"),
    )
    long = wide.unpivot(["benchmark"], [c for c in wide.columns if "/" in c], "name", "value")
    return long.select(
        "benchmark", F.split("name", "/")[0].alias("task"), F.split("name", "/")[1].alias("metric"),
        "value",
    )


@query(
    "compare_metrics",
    """WITH m AS (SELECT l_linestatus AS st, CASE WHEN l_returnflag = 'A' THEN 'web' ELSE 'external' END
        AS benchmark, avg((l_discount > 0.05)::INT::DOUBLE) AS a, avg(l_discount) AS f,
        avg((l_quantity > 25)::INT::DOUBLE) AS c, avg(l_quantity) AS p FROM lineitem GROUP BY ALL),
    l AS (SELECT st, benchmark, 'qa' AS task, 'answer_accuracy' AS metric, a AS v, true AS up FROM m
      UNION ALL SELECT st, benchmark, 'qa', 'mean_token_f1', f, true FROM m
      UNION ALL SELECT st, benchmark, 'grounding', 'click_accuracy', c, true FROM m
      UNION ALL SELECT st, benchmark, 'grounding', 'median_pixel_distance', p, false FROM m)
    SELECT benchmark, task, metric, round(x.v, 6) AS baseline, round(y.v, 6) AS tuned,
      round(y.v - x.v, 6) AS delta, CASE WHEN up THEN y.v > x.v ELSE y.v < x.v END AS improved
    FROM (SELECT * FROM l WHERE st = 'F') x JOIN (SELECT st, benchmark, task, metric, v FROM l
      WHERE st = 'O') y USING (benchmark, task, metric) WHERE benchmark = 'web' OR task = 'grounding'""",
)
def compare_metrics(spark, folder):
    return rounded(
        gates.compare_metrics(
            _two_benchmarks(spark, folder, "F"), _two_benchmarks(spark, folder, "O")
        )
    )


@query(
    "select_checkpoint",
    f"""WITH {_VALIDATION}, w AS (SELECT run_id, max(value) FILTER (metric =
        'click_inside_bbox_accuracy') AS k, max(value) FILTER (metric = 'action_name_accuracy') AS n,
        max(value) FILTER (metric = 'action_argument_accuracy') AS a FROM cn GROUP BY run_id)
    SELECT run_id FROM w JOIN vg USING (run_id) WHERE advance ORDER BY k DESC, n DESC, a DESC,
      split_part(run_id, '-', 2)::BIGINT LIMIT 1""",
)
def select_checkpoint(spark, folder):
    candidates = _suite_candidates(spark, folder)
    judged = gates.validation_gate(candidates, _suite_control(spark, folder), ["run_id"])
    wide = candidates.groupBy("run_id").agg(
        *[
            F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name)
            for name in order.SELECTION
        ]
    )
    rows = wide.join(judged, "run_id").select(
        "run_id", *order.SELECTION, (~F.col("advance")).alias("regressed"),
        F.split("run_id", "-")[1].cast("bigint").alias("step"),
    )
    return order.select_checkpoint(rows).select("run_id")


def _registry(spark, folder):
    rows = table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return rows.select(
        *[F.expr(v).alias(k) for k, v in B.RUN_COLUMNS.items()],
        F.sha2(F.round("s_acctbal", 0).cast("bigint").cast("string"), 256).alias("adapter_sha256"),
        F.col("s_nationkey"),
    )


_REGISTRY = f"""r AS (SELECT {', '.join(
    f"{v.replace('STRING', 'VARCHAR').replace('l_suppkey', 's_suppkey')} AS {k}"
    for k, v in B.RUN_COLUMNS.items())}, sha256(round(s_acctbal)::BIGINT::VARCHAR) AS adapter_sha256,
  s_nationkey FROM supplier)"""
_SIZE_RANK = "CASE size WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query(
    "latest_candidate",
    f"""WITH {_REGISTRY} SELECT size, step, seed FROM r
        ORDER BY {_SIZE_RANK} DESC, step DESC, seed DESC LIMIT 1""",
)
def latest_candidate(spark, folder):
    return order.latest_candidate(_registry(spark, folder)).select("size", "step", "seed")


@query("registry_order", f"WITH {_REGISTRY} SELECT run_id, size, step, seed FROM r")
def registry_order(spark, folder):
    return order.registry_order(_registry(spark, folder)).select("run_id", "size", "step", "seed")


@query(
    "registry_conflicts",
    f"""WITH {_REGISTRY} SELECT 'identity' AS kind, size || '|' || seed || '|' || step AS key,
        count(*)::BIGINT AS n FROM r GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'adapter', adapter_sha256, count(*)::BIGINT FROM r GROUP BY 2
        HAVING count(*) > 1""",
)
def registry_conflicts(spark, folder):
    return gates.registry_conflicts(_registry(spark, folder))


@query(
    "register_candidate",
    f"""WITH {_REGISTRY}, old AS (SELECT * FROM r WHERE s_nationkey < 12), i AS (SELECT size, seed,
        step, max(adapter_sha256) AS a, max(run_id) AS run FROM old GROUP BY ALL),
    t AS (SELECT DISTINCT adapter_sha256, true AS taken FROM old)
    SELECT r.run_id, CASE WHEN run IS NOT NULL AND a = r.adapter_sha256 AND run = r.run_id
        THEN 'already_registered' WHEN run IS NOT NULL THEN 'identity_conflict'
        WHEN taken THEN 'adapter_conflict' ELSE 'insert' END AS decision
    FROM r LEFT JOIN i USING (size, seed, step) LEFT JOIN t ON t.adapter_sha256 = r.adapter_sha256""",
)
def register_candidate(spark, folder):
    incoming = _registry(spark, folder)
    registry = incoming.where("s_nationkey < 12")
    return gates.register_candidate(registry, incoming).select("run_id", "decision")


@query(
    "identity_issues",
    """SELECT 'run-' || l_suppkey::VARCHAR AS run_id, CASE WHEN l_suppkey % 5 = 0
         THEN 'different_base_model' ELSE 'adapter_hash_missing' END AS issue
       FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 5 = 0 OR l_suppkey % 4 = 0""",
)
def identity_issues(spark, folder):
    key = F.col("l_suppkey")
    runs = table(spark, folder, "lineitem").select(key).distinct().select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        F.when(key % 5 == 0, "other").otherwise("base").alias("model"),
        F.lit("r1").alias("model_revision"),
        F.when(key % 4 == 0, "").otherwise("hash").alias("adapter_sha256"),
    )
    reference = runs.where(F.col("model") == "base").select("model", "model_revision")
    return gates.identity_issues(runs, reference)


@query(
    "dashboard_check",
    f"""WITH {_C} SELECT run_id, suite, task, metric, round(value, 6) AS receipt,
        round(value + 0.001, 6) AS dashboard FROM c WHERE metric = 'parse_rate'""",
)
def dashboard_check(spark, folder):
    receipt = B.candidate_metrics(spark, folder)
    shifted = F.when(F.col("metric") == "parse_rate", F.col("value") + 0.001).otherwise(
        F.col("value") + 1e-13
    )
    return rounded(
        gates.dashboard_check(
            receipt.withColumn("value", shifted), receipt, ["run_id", *KEYS]
        )
    )


# ---- receipts and completion ------------------------------------------------------------------

_SUITES = ("iid", "domain_balanced", "distribution_shift")


def _grid(spark, folder):
    """Every order is a run; its lines are the shards that reported."""
    orders = table(spark, folder, "orders")
    cells = F.array(*[F.lit(i) for i in (1, 2, 3, 4)], F.lit(None).cast("int"))
    runs = orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "base").otherwise("sft").alias("control"),
    )
    grid = runs.select(
        "*", F.lit("iid").alias("suite"), F.explode(cells).alias("shard_index")
    ).withColumn("num_shards", F.lit(4))
    shard = ((F.col("l_linenumber") - 1) % 4 + 1).alias("shard_index")  # lines beyond four fold
    shards = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), shard).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("examples"),
        F.max((F.col("l_tax") > 0.07).cast("int")).alias("exit_code"),
    )
    merged = shards.groupBy("run_id").agg(
        F.sum("examples").alias("examples"), F.lit(0).alias("exit_code")
    ).withColumn("shard_index", F.lit(None).cast("int"))
    terminals = shards.unionByName(merged).join(runs, "run_id").withColumns(
        {"suite": F.lit("iid"), "status": F.lit("complete")}
    )
    identities = runs.select(
        "run_id", F.lit("m").alias("model"), F.lit("r").alias("model_revision"),
        F.when(F.col("run_id") % 3 == 0, "a").alias("adapter"),
        F.when(F.col("run_id") % 3 == 0, "h").alias("adapter_sha256"),
    )
    return terminals, grid, identities


@query(
    "evaluation_receipt",
    """WITH s AS (SELECT l_orderkey AS run_id, (l_linenumber - 1) % 4 + 1 AS i, sum(l_quantity::BIGINT) AS ex,
         max((l_tax > 0.07)::INT) AS code FROM lineitem GROUP BY ALL),
    m AS (SELECT run_id, count(*) FILTER (code = 0) AS good, sum(ex) AS ex FROM s GROUP BY run_id)
    SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'base' ELSE 'sft' END AS control,
      CASE WHEN coalesce(good, 0) < 4 THEN 'incomplete_grid'
        WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'base_has_adapter' ELSE 'valid' END AS verdict
    FROM orders LEFT JOIN m ON o_orderkey = run_id""",
)
def evaluation_receipt(spark, folder):
    return gates.evaluation_receipt(*_grid(spark, folder)).select("run_id", "control", "verdict")


def _study(spark, folder):
    """Orders as jobs, in groups by priority, with faults derived from their columns."""
    orders = table(spark, folder, "orders")
    good = F.sha2(F.col("o_orderkey").cast("string"), 256)
    key = F.col("o_orderkey")
    base = orders.select(
        key.cast("string").alias("job_id"),
        F.col("o_orderpriority").alias("size"), F.lit(500).alias("step"), key.alias("seed"),
        F.col("o_orderpriority").alias("group"), "o_custkey", "o_orderstatus",
        F.when(F.col("o_custkey") % 50 == 0, F.sha2(F.lit("shared"), 256))
        .when(F.col("o_custkey") % 17 == 0, F.lit("bad"))
        .otherwise(good).alias("hash"),
    )
    jobs = base.select(
        "job_id", F.col("size").alias("dataset_size"), "seed", F.col("step").alias("total_optimizer_steps")
    )
    receipts = base.select(
        "job_id", F.lit(gates.RECEIPT_KINDS["job"]).alias("kind"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("complete_pass").alias("status"),
        F.lit(500).alias("final_step"),
    )
    training = base.select(
        "job_id", F.lit(gates.RECEIPT_KINDS["training"]).alias("kind"),
        F.lit(500).alias("completed_step"), F.lit("complete_pass").alias("status"),
        F.col("hash").alias("adapter_sha256"),
    )
    evaluation = base.where(F.col("o_custkey") % 13 != 0).select(
        "job_id", F.lit(gates.RECEIPT_KINDS["evaluation"]).alias("kind"), F.lit("sft").alias("control"),
        F.col("hash").alias("adapter_sha256"), F.lit(2).alias("num_shards"),
    )
    tasks = F.array(F.lit("qa"), F.lit("grounding"), F.lit("action"))
    filler = F.sha2(F.lit("x"), 256)
    suites = base.select(
        "job_id", F.explode(F.array(*[F.lit(s) for s in _SUITES])).alias("suite")
    ).withColumns({"metrics_sha256": filler, "run_metadata_sha256": filler, "tasks": tasks})
    shards = suites.select(
        "job_id", "suite", F.explode(F.array(F.lit(0), F.lit(1))).alias("shard_index")
    ).withColumns({"metrics_sha256": filler, "run_metadata_sha256": filler, "signature": filler})
    expected = base.select("group", "size", "step", "seed")
    return base, expected, jobs, receipts, training, evaluation, suites, shards


_ISSUES = """
o AS (SELECT o_orderkey::VARCHAR AS job_id, *, o_custkey % 13 = 0 AS gone,
  o_custkey % 50 = 0 AS shared, o_custkey % 17 = 0 AND o_custkey % 50 <> 0 AS bad FROM orders),
i AS (SELECT job_id, 'missing required receipt' AS issue FROM o WHERE gone
  UNION ALL SELECT job_id, 'job result is not complete_pass' FROM o
    WHERE NOT gone AND o_orderstatus = 'P'
  UNION ALL SELECT job_id, 'training lacks a valid adapter hash' FROM o WHERE NOT gone AND bad
  UNION ALL SELECT job_id, 'evaluation lacks a valid adapter hash' FROM o WHERE NOT gone AND bad
  UNION ALL SELECT job_id, 'adapter hash is reused' FROM o WHERE NOT gone AND shared
    AND job_id <> (SELECT min(job_id) FROM o WHERE shared))
"""


@query("completion_issues", f"WITH {_ISSUES} SELECT job_id, issue FROM i")
def completion_issues(spark, folder):
    return gates.completion_issues(*_study(spark, folder)[1:], num_shards=2)


@query(
    "completion_audit",
    f"""WITH {_ISSUES}, c AS (SELECT job_id, count(*) AS n, max(issue = 'missing required receipt')
        AS m FROM i GROUP BY job_id)
    SELECT job_id, CASE WHEN n IS NULL THEN 'complete' WHEN m THEN 'incomplete' ELSE 'invalid' END
      AS status, coalesce(n, 0)::BIGINT AS issues FROM o LEFT JOIN c USING (job_id)""",
)
def completion_audit(spark, folder):
    base, *rest = _study(spark, folder)
    issues = gates.completion_issues(*rest, num_shards=2)
    return gates.completion_audit(base.select("job_id"), issues)


@query(
    "valid_sha256",
    """SELECT o_orderkey, false AS short_ok, true AS whole_ok FROM orders""",
)
def valid_sha256(spark, folder):
    value = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return table(spark, folder, "orders").select(
        "o_orderkey", gates.valid_sha256(F.substring(value, 1, 40)).alias("short_ok"),
        gates.valid_sha256(value).alias("whole_ok"),
    )


@query(
    "reproducibility_gate",
    """SELECT source AS file, count(*)::BIGINT AS reference_rows,
         count(*) FILTER (doc_id % 20 <> 7 OR source <> 'src3')::BIGINT AS candidate_rows,
         count(*) = count(*) FILTER (doc_id % 20 <> 7 OR source <> 'src3') AS exact_match
       FROM documents GROUP BY source""",
)
def reproducibility_gate(spark, folder):
    """Two runs that write the texts of each source; the second loses some of one source."""
    docs = table(spark, folder, "documents").select(
        F.col("source").alias("file"), F.col("text").alias("line"), "doc_id"
    )
    other = docs.where((F.col("doc_id") % 20 != 7) | (F.col("file") != "src3"))
    names = [f"src{i}" for i in range(20)]
    return gates.reproducibility_gate(docs, other, names).select(
        "file", "reference_rows", "candidate_rows", "exact_match"
    )


@query(
    "runtime_comparison",
    """SELECT user_id AS run_id,
         (epoch_us(min(ts)) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e6 AS setup_seconds,
         (epoch_us(max(ts)) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e6 AS wall_seconds
       FROM events GROUP BY user_id""",
)
def runtime_comparison(spark, folder):
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.groupBy(F.col("user_id").alias("run_id")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("complete")
    )
    rows = ends.select(
        "run_id",
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("event"), F.col("start").alias("timestamp_utc")),
                F.struct(F.lit("complete").alias("event"), F.col("complete").alias("timestamp_utc")),
            )
        ).alias("e"),
    ).select("run_id", "e.*", F.lit(1.0).alias("elapsed_seconds"))
    created = ends.select("run_id", F.to_timestamp(F.lit("2024-01-01")).alias("created"))
    return gates.runtime_comparison(rows, created).select(
        "run_id", "setup_seconds", "wall_seconds"
    )
