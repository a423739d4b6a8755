import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentcorpus import session
from agentcorpus.catalogue import join_queries
from agentcorpus.operators import align, audit, expand, filters, gates, order, records, sample, score, setops, split, study
from agentcorpus.plans import evaluation, ladder
from agentcorpus.sources import manifests


def trajectory(spark):
    def step(name, action, shot="screenshot_001.png", thought=" t "):
        return {
            "screenshot": shot, "image_w": 1280, "image_h": 720,
            "other_obs": {
                "page_index": 0, "open_pages_titles": ["Home"],
                "open_pages_urls": ["https://www.shop.example/a"],
            },
            "action": {"action_output": {"thought": thought, "action_name": name, "action": action}},
        }

    steps = {
        "10": step("send_msg_to_user", {"msg": "done"}),
        "2": step("click", {"bbox": [100, 100, 100, 50]}),
        "3": step("click", {"bbox": [1, 1, 0, 1]}),
        "4": step("click", {"x": 1, "y": 1}, shot=""),
    }
    rows = [
        ("s1", json.dumps({"goal": " Buy it "}), json.dumps(steps)),
        ("s2", json.dumps({"goal": ""}), json.dumps({"0": step("go_back", {}, thought="")})),
        ("s3", "{}", "not json"),
        ("s4", '{"goal":"g"}', json.dumps({"first": step("go_back", {})})),
    ]
    return spark.createDataFrame(rows, "sample_id string, instruction string, trajectory string")


def test_trajectory_expansion(spark):
    source = {"id": "src"}
    rows = expand.explode_trajectory(trajectory(spark), source, 5, 10).orderBy("step_index").collect()
    assert [(r["trajectory_id"], r["step_index"]) for r in rows] == [("s1", 2), ("s1", 10)]
    assert rows[0]["bbox_normalized"] == [100 / 1280, 100 / 720, 200 / 1280, 150 / 720]
    assert rows[0]["domain"] == "shop.example" and rows[0]["question"] == "Buy it"
    assert "## Step 2\nTHOUGHT: t\nACTION: {" in rows[1]["prompt"]
    assert rows[1]["answer"] == '{"thought":"t","action":{"name":"send_msg_to_user","msg":"done"}}'
    assert expand.explode_trajectory(trajectory(spark), source, 0, 10).where("history_steps > 0").count() == 0
    assert expand.explode_trajectory(trajectory(spark), source, 5, 1).count() == 1


def test_history_frame_crosses_spans(spark):
    rng = random.Random(2)
    rows = [(t, i, f"{t}{i}") for t in "ab" for i in range(rng.randint(20, 40))]
    df = spark.createDataFrame(rows, "t string, i int, name string")
    got = {(r["t"], r["i"]): [h["name"] for h in r["history"]]
           for r in expand.history_frame(df, "t", "i", ["name"], 3, span=4).collect()}
    assert len(got) == len(rows)
    for t, i, _ in rows:
        assert got[(t, i)] == [f"{t}{j}" for j in range(max(0, i - 3), i)]


def test_destinations_keep_units_whole(spark):
    shares = {"train": 70, "domain_balanced": 15, "distribution_shift": 15}
    rows = [(str(i), f"t{i % 40}", f"d{(i * 7) % 25}.example" if i % 90 else "unknown", "training", "qa")
            for i in range(600)]
    df = records.with_unit(spark.createDataFrame(
        rows, "id string, trajectory_id string, domain string, source_role string, task string"))
    assigned = split.assign_destination(df, 53, shares, 20)
    assert split.destination_conflicts(assigned).count() == 0
    per_unit = assigned.groupBy("unit").agg(F.count_distinct(F.coalesce("destination", F.lit("none"))).alias("n"))
    assert per_unit.where("n > 1").count() == 0
    bad = df.withColumn("source_role", F.lit("odd"))
    # An unknown role is an error wherever the unit is not excluded anyway.
    single = bad.withColumn("domain", F.lit("d1.example"))
    with pytest.raises(Exception, match="unknown source role"):
        split.assign_destination(single, 53, shares, 20).collect()


def test_proportional_targets_are_exact(spark):
    counts = spark.createDataFrame([("a", 5, 0), ("b", 3, 1), ("c", 3, 2)], "source string, train bigint, ord int")
    got = {(r["source"], r["split"]): r["target"]
           for r in split.proportional_targets(counts, {"validation": 7, "test": 2}).collect()}
    assert sum(v for (_, s), v in got.items() if s == "validation") == 7
    assert got[("a", "validation")] == 3 and got[("a", "test")] == 1


def test_scores(spark):
    rows = [
        ("1", "action", '{"name":"click","x":20,"y":50}', [0.2, 0.4, 0.3, 0.6],
         '{"thought":"t","action":{"name":"click","x":25,"y":50}}'),
        ("2", "action", '{"name":"scroll","delta_x":0,"delta_y":50}', None,
         '{"thought":"t","action":{"name":"scroll","delta_x":0,"delta_y":40}}'),
        ("3", "action", '{"name":"click","x":1,"y":1}', [0.0, 0.0, 0.1, 0.1], "not json"),
        ("4", "action", '{"name":"press","key":"a","n":1}', None,
         '{"thought":"t","action":{"name":"press","n":1.0,"key":"a"}}'),
    ]
    df = spark.createDataFrame(
        rows, "id string, task string, target_action string, bbox_normalized array<double>, prediction string"
    ).withColumns({"image_width": F.lit(1000), "image_height": F.lit(500)})
    scored = {r["id"]: r for r in score.action_score(df).collect()}
    assert scored["1"]["click_inside_bbox"] and scored["1"]["click_distance_px"] == 50.0
    assert scored["2"]["action_arguments_correct"] and not scored["2"]["action_exact"]
    assert scored["3"]["error_category"] == "output_format"
    assert scored["4"]["action_exact"]
    summary = score.action_summary(score.action_score(df)).first()
    assert summary["json_parse_rate"] == 0.75
    assert summary["click_inside_bbox_accuracy"] == 0.5 and summary["click_median_distance_px"] == 50.0
    empty = score.action_summary(score.action_score(df.where("id = '2'"))).first()
    assert empty["click_inside_bbox_accuracy"] is None and empty["click_median_distance_px"] is None


def test_audit_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "id string, domain string, task string")
    row = audit.audit(empty).first()
    assert row["examples"] == 0 and row["effective_domains"] == 0.0 and row["max_domain_share"] == 0.0
    macro = audit.macro_metric(spark.createDataFrame([], "domain string, hit boolean"), "hit", "domain").first()
    assert macro["examples"] == 0 and macro["micro"] is None and macro["macro"] is None


def test_checks_raise(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    with pytest.raises(align.CheckFailed, match="twice"):
        align.require_empty(align.duplicate_ids(ids), "twice")
    with pytest.raises(align.CheckFailed):
        filters.exclude_sources(spark.createDataFrame([("bad",)], "source string"), ["bad"])


def test_checkpoint_choice(spark):
    rows = [(500, 0.5, 0.4, 0.1, False), (1000, 0.5, 0.4, 0.1, False), (1500, 0.9, 0.9, 0.9, True),
            (2000, None, 0.9, 0.9, False)]
    gate_rows = spark.createDataFrame(
        rows, "step int, click_inside_bbox_accuracy double, action_name_accuracy double, "
        "action_argument_accuracy double, regressed boolean")
    assert order.select_checkpoint(gate_rows).first()["step"] == 500
    broken = gate_rows.withColumn("action_name_accuracy", F.lit(float("nan")))
    with pytest.raises(Exception, match="non-finite"):
        order.select_checkpoint(broken).collect()


def test_variability_conventions(spark):
    rows = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("one", 2.0)], "metric string, value double")
    population = {r["metric"]: r["population_std"] for r in gates.shard_variability(rows, ["metric"], 2).collect()}
    sample_std = {r["metric"]: r["sample_std"] for r in gates.receipt_variability(rows, ["metric"]).collect()}
    assert population["m"] == 1.0 and sample_std["m"] == pytest.approx(statistics.stdev([1, 3]))
    assert sample_std["one"] == 0.0


def test_primary_variability(spark):
    rows = [("s1", "w", "qa", "acc", 1.0), ("s2", "w", "qa", "acc", 3.0), ("s1", "w", "qa", "other", 9.0),
            ("s2", "x", "qa", "acc", 5.0)]
    df = spark.createDataFrame(rows, "shard string, suite string, task string, metric string, value double")
    names = {"a": ("w", "qa", "acc"), "none": ("w", "action", "acc")}
    found = [tuple(r) for r in gates.primary_variability(df, "shard", names).collect()]
    assert found == [("a", 2, 2.0, 1.0, 1.0, 3.0)]
    with pytest.raises(Exception, match="disagree on availability of b"):
        gates.primary_variability(df, "shard", {"b": ("x", "qa", "acc")}).collect()


def gate_tables(spark, **changes):
    kinds = ("run_id string, suite string, task string, metric string, value double, model string, "
             "model_revision string, adapter_sha256 string")
    keys = [key.split("/") for key in gates.PERCEPTION]
    row = {"model": "m", "model_revision": "r", "adapter_sha256": "a", **changes}
    def table(run, value, model, revision, adapter, some=keys):
        return spark.createDataFrame([(run, *key, value, model, revision, adapter) for key in some], kinds)
    candidate = table("c", 0.5, row["model"], row["model_revision"], row["adapter_sha256"])
    return candidate, table("b", 0.4, "m", "r", None), table("u", 0.1, "m", "r", None), table


def test_regression_gate(spark):
    candidate, reference, untouched, table = gate_tables(spark)
    row = gates.regression_gate(candidate, reference, ["run_id"], untouched).first()
    assert row["decision"] == "continue" and row["adapter_sha256"] == "a"
    assert row["mean_perception_delta"] == pytest.approx(0.1)
    assert set(row["delta_vs_untouched"]) == set(gates.PERCEPTION)
    assert all(v == pytest.approx(0.4) for v in row["delta_vs_untouched"].values())
    for changes, message in (
        ({"model": "n"}, "another base model"), ({"model_revision": None}, "another base model"),
        ({"adapter_sha256": None}, "no adapter hash"), ({"adapter_sha256": ""}, "no adapter hash"),
    ):
        with pytest.raises(Exception, match=message):
            gates.regression_gate(gate_tables(spark, **changes)[0], reference, ["run_id"]).collect()
    fewer = candidate.where(F.concat_ws("/", "suite", "task", "metric") != gates.PERCEPTION[0])
    with pytest.raises(Exception, match="perception metrics are missing"):
        gates.regression_gate(fewer, reference, ["run_id"]).collect()
    with pytest.raises(Exception, match="untouched baseline"):
        other = table("u", 0.1, "m", "q", None)
        gates.regression_gate(candidate, reference, ["run_id"], other).collect()


def test_too_few_archived_rows(spark):
    rows = spark.range(40).select(F.col("id"), F.concat(F.lit("i"), "id").alias("image"))
    images = rows.where("id < 33").select("image")
    assert sample.retain_archived(rows, images, [F.col("id")], 64).count() == 33
    assert sample.retain_archived(rows, images.limit(5), [F.col("id")], 5).count() == 5
    with pytest.raises(sample.Infeasible):
        sample.retain_archived(rows, images.limit(31), [F.col("id")], 64)


def test_paired_bootstrap_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    deltas = rng.choice([-1.0, 0.0, 1.0], size=400, p=[0.2, 0.5, 0.3])
    pairs = spark.createDataFrame([(float(d), 0.5) for d in deltas], "success_delta double, reward_delta double")
    row = study.paired_bootstrap(pairs, samples=2000, seed=1).first()
    brute = np.sort([rng.choice(deltas, size=len(deltas)).mean() for _ in range(2000)])
    low, high = study.bootstrap_positions(2000)
    assert row["paired_episodes"] == 400
    assert row["success_rate_delta"] == pytest.approx(deltas.mean())
    assert row["ci_low"] == pytest.approx(brute[low], abs=0.02)
    assert row["ci_high"] == pytest.approx(brute[high], abs=0.02)
    assert study.paired_bootstrap(pairs, samples=2000, seed=1).first() == row
    none = study.paired_bootstrap(pairs.limit(0), samples=50).first()
    assert none["paired_episodes"] == 0 and none["ci_low"] == 0.0


def test_clustered_bootstrap(spark):
    """The interval is that of drawing whole clusters with replacement, and needs no join."""
    rng = np.random.default_rng(3)
    rows = [(c, float(rng.random() < 0.2 + 0.6 * (c % 3 == 0))) for c in range(90) for _ in range(1 + c % 7)]
    df = spark.createDataFrame([*rows, (5, None), (None, 1.0)], "c int, v double")
    found = study.clustered_bootstrap(df, "c", "v", samples=800, seed=2)
    row = found.first()
    groups = [[v for k, v in rows if k == c] for c in range(90)] + [[1.0]]
    draws = []
    for _ in range(800):
        drawn = [groups[i] for i in rng.integers(0, len(groups), len(groups))]
        draws.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
    low, high = np.quantile(draws, [0.025, 0.975])
    assert row["clusters"] == 91
    assert row["mean"] == pytest.approx(np.mean([v for _, v in rows] + [1.0]))
    assert row["ci_low"] == pytest.approx(low, abs=0.03) and row["ci_high"] == pytest.approx(high, abs=0.03)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert study.clustered_bootstrap(df.repartition(9), "c", "v", samples=800, seed=2).first() == row
    none = study.clustered_bootstrap(df.limit(0), "c", "v").first()
    assert none["clusters"] == 0 and none["mean"] is None and none["ci_low"] is None


def test_rewards(spark):
    signals = spark.createDataFrame([({"progress": 0.5, "task_success": 1.0},)], "s map<string,double>")
    assert signals.select(study.reward_components(F.col("s")).alias("r")).first()["r"]["reward"] == pytest.approx(1.1)
    odd = spark.createDataFrame([({"other": 1.0},)], "s map<string,double>")
    with pytest.raises(Exception, match="unknown reward signals"):
        odd.select(study.reward_components(F.col("s")).alias("r")).collect()
    with pytest.raises(ValueError):
        study.reward_weights({"other": 1.0})


def test_malformed_manifest_fails(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"a"}\n\n{"id":"b"}\n')
    assert manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n{"id": \n')
    with pytest.raises(Exception):
        manifests.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_history_with_gaps_in_step_numbers(spark):
    rows = [("a", s, f"n{s}") for s in (0, 500, 1000, 1001)] + [("b", 7, "x")]
    df = spark.createDataFrame(rows, "t string, i long, name string")
    got = {(r["t"], r["i"]): [h["step"] for h in r["history"]]
           for r in expand.history_frame(df, "t", "i", ["name"], 2, span=4).collect()}
    assert got == {("a", 0): [], ("a", 500): [0], ("a", 1000): [0, 500], ("a", 1001): [500, 1000], ("b", 7): []}


def test_missing_and_double_partners_are_errors(spark):
    rows = [("base", "1", "x"), ("new", "1", "y"), ("base", "2", "z")]
    df = spark.createDataFrame(rows, "label string, id string, prediction string")
    good = align.align_predictions(df.where("id = '1'"), ["base", "new"]).first()
    assert (good["base"], good["new"]) == ("x", "y")
    for bad in (df, df.where("id = '1'").union(df.where("id = '1'"))):
        with pytest.raises(Exception, match="expected one row"):
            align.align_predictions(bad, ["base", "new"]).collect()
    episodes = spark.createDataFrame(
        [("t1", 1, "c", True, 1.0), ("t1", 1, "n", False, 2.0), ("t2", 1, "c", True, 1.0)],
        "task_id string, seed int, variant_id string, success boolean, total_reward double",
    )
    assert align.pair_episodes(episodes.where("task_id = 't1'"), "c", "n").first()["reward_delta"] == 1.0
    with pytest.raises(Exception, match="expected one row"):
        align.pair_episodes(episodes, "c", "n").collect()


def test_disagreeing_image_checkpoints_are_an_error(spark):
    rows = [("a", "p", 1), ("a", "p", 1), ("b", "q", 2)]
    df = spark.createDataFrame(rows, "locator_id string, image string, image_width int")
    assert align.image_index_merge(df).count() == 2
    with pytest.raises(Exception, match="disagree"):
        align.image_index_merge(df.union(spark.createDataFrame([("b", "q", 3)], df.schema))).collect()


def test_checkpoint_choice_refuses_doubtful_gates(spark):
    columns = "click_inside_bbox_accuracy double, action_name_accuracy double, action_argument_accuracy double, step int, regressed boolean"
    one = (0.5, 0.5, 0.5, 500, False)
    with pytest.raises(ValueError, match="twice"):
        order.select_checkpoint(spark.createDataFrame([one, one], columns))
    with pytest.raises(ValueError, match="without regressions"):
        order.select_checkpoint(spark.createDataFrame([(*one[:4], True)], columns))


def test_readers_keep_paths_lines_and_unknown_keys(spark, tmp_path):
    import hashlib
    import json

    from agentcorpus.sources import checksums, progress

    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / "logs" / name).mkdir(parents=True)
        event = {"event": "complete", "stage": "benchmark_x", "completed": value}
        (tmp_path / "logs" / name / "x.log").write_text("note\n" + json.dumps(event) + "\n")
    found = {r["log"]: r["completed"] for r in progress.read_progress_log(spark, str(tmp_path / "logs")).collect()}
    assert found == {"a/x.log": 1, "b/x.log": 2}
    sums = {r["file"]: r["sha256"] for r in checksums.content_checksums(spark, str(tmp_path / "logs"), "b/x.log").collect()}
    assert sums == {"a/x.log": hashlib.sha256((tmp_path / "logs/a/x.log").read_bytes()).hexdigest()}
    receipt = {"run_id": "r", "seed": 1, "suites": {"iid": {"merged": {"tasks": {"qa": {"f1": "0.5", "examples": "9"}}}}}}
    (tmp_path / "receipts").mkdir()
    (tmp_path / "receipts/one.json").write_text(json.dumps(receipt, indent=2))
    (tmp_path / "receipts/two.json").write_text(json.dumps(receipt) + "\n" + json.dumps(receipt) + "\n")
    assert manifests.read_receipts(spark, str(tmp_path / "receipts")).count() == 3
    (tmp_path / "m.jsonl").write_text('{"id": "1", "colour": "red"}\n\n{"id": "2"}\n')
    extra = {r["id"]: r["extra"] for r in manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert extra == {"1": {"colour": "red"}, "2": None}
    (tmp_path / "e.jsonl").write_text('{"episode_id": "1"}\n{broken\n{"episode_id": "2"}\n{"x": 1}\n')
    valid, invalid = manifests.read_episodes(spark, str(tmp_path / "e.jsonl"))
    assert valid.count() == 2
    assert {(r["_file"], r["_line"]) for r in invalid.collect()} == {("e.jsonl", 2), ("e.jsonl", 4)}


@pytest.mark.parametrize("limit", [4, 1000, 1001, 5000])
def test_first_few_has_no_cap(spark, limit):
    from agentcorpus.operators.ranking import first_few

    df = spark.range(6000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    found = first_few(df, ["k"], [F.desc("v")], limit).groupBy("k").agg(F.count("v").alias("n"), F.max("rank").alias("r"))
    assert {(r["n"], r["r"]) for r in found.collect()} == {(min(limit, 3000), min(limit, 3000))}


def test_staged_columns_are_projected_before_the_generator(spark):
    """Inside the generator an expression is neither shared nor split into small methods."""
    from agentcorpus.functions.staging import staged

    held = staged(spark.range(3), {"a": F.col("id") * 7, "b": F.col("id") + 1}).where("a > 6")
    plan = held._jdf.queryExecution().executedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate" in line]
    assert generators and not any("* 7" in line for line in generators)
    assert [tuple(r) for r in held.orderBy("id").collect()] == [(1, 7, 2), (2, 14, 3)]


def test_diagnostic_order_reads_no_json_in_comparisons(spark):
    from agentcorpus.operators import order

    rows = spark.createDataFrame(
        [("1", '{"name":"go_back"}', '{"thought":"t","action":{"name":"go_back"}}')],
        "id string, target_action string, prediction string",
    ).selectExpr("*", "cast(null as array<double>) bbox_normalized", "10 image_width", "10 image_height")
    scored = score.action_score(rows)
    top = order.diagnostic_rows(scored, order.action_diagnostic_order(scored), 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    sort = next(line for line in plan.splitlines() if "TakeOrderedAndProject" in line)
    assert "get_json_object" not in sort.split("output=")[0]
    assert top.first()["action_exact"] and top.first()["target_name"] == "go_back"


def test_orders_without_a_key_are_shards_too(spark, tmp_path):
    # a join on the key lost them; SQL groups them
    rows = [(None, 1), (None, 3), (1, 1), (1, 2), (2, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    found = join_queries.shard_selection_issues(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {(None, 2, 2), (2, 1, 1)}


@pytest.mark.parametrize("num_shards", [2, 70])
def test_shards_are_whole_without_distinct_rows(spark, num_shards):
    whole = list(range(num_shards))
    cases = {
        "whole": whole, "short": whole[1:], "twice": [*whole[:-1], 0], "beyond": [*whole[1:], num_shards],
        "more": [*whole, 0], "null": [*whole[1:], None], "below": [*whole[1:], -1],
    }
    rows = [(k, i) for k, listed in cases.items() for i in listed]
    df = spark.createDataFrame(rows, "suite string, shard_index int")
    seen = df.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), *gates._seen_shards(num_shards))
    got = {r["suite"] for r in seen.where((F.col("n") == num_shards) & F.col("_every")).collect()}
    assert got == {"whole"}
    if num_shards == 2:  # one shuffle of sums, none of distinct indices
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_name_accuracy_takes_the_name_at_hand(spark):
    rows = spark.createDataFrame([("click", True), ("click", False)], "target_name string, action_name_correct boolean")
    assert score.action_name_accuracy(rows).first().asDict() == {
        "action": "click", "examples": 2, "action_name_accuracy": 0.5,
    }


def test_merge_issues_in_one_pass(spark):
    """Repeated manifest ids come with the coverage; both checks took a shuffle of their own."""
    expected = spark.createDataFrame([(i,) for i in "aabcd"], "id string")
    predictions = spark.createDataFrame([(i,) for i in "abbce"], "id string")
    found = {r["id"]: r["issue"] for r in align.merge_issues(expected, predictions).collect()}
    assert found == {"a": "not_unique", "b": "duplicate", "d": "missing", "e": "extra"}


def test_ladder_forms_leakage_keys_once(spark, monkeypatch):
    """Three gates and the audit read one stored table of shared keys; each shuffled all keys before."""
    made, keys = [], setops.leakage_keys
    monkeypatch.setattr(setops, "leakage_keys", lambda *sides: made.append(sides) or keys(*sides))
    training = spark.createDataFrame(
        [(f"t{i}", "qa", f" Site{i % 4}.example", None) for i in range(12)],
        "id string, task string, domain string, image string",
    )
    suites = spark.createDataFrame(
        [("e1", "iid", "site1.example", None), ("e2", "other", "far.example", "a.png")],
        "id string, suite string, domain string, image string",
    )
    tasks = {"qa": ladder.TaskSpec(sizes={"small": 4, "large": 8}, max_domain_share=0.5)}
    built = ladder.build_ladder(training, suites, tasks, 1, {"iid": ["id"], "other": ["known_domain"]})
    leakage = built["leakage"].first()
    assert len(made) == 1
    assert leakage["training_examples"] == 12 and leakage["known_domain_overlap_count"] == 1
    assert {r["tier"]: r["examples"] for r in built["tier_audit"].collect()} == {"small": 4, "large": 8}
    with pytest.raises(align.CheckFailed, match="suite overlap"):
        ladder.build_ladder(training, suites, tasks, 1, {"iid": ["known_domain"]})
    shared = suites.withColumn("id", F.lit("t3"))
    with pytest.raises(align.CheckFailed, match="share rows"):
        ladder.build_ladder(training, shared, tasks, 1, {"iid": ["id"]})


def test_unit_state_aggregates_by_hash(spark, capsys):
    """Lowest and highest partition are numbers while they are aggregated; texts made Spark sort all units."""
    rows = [("a", "x"), ("a", "y"), ("a", "x"), ("b", "unknown"), ("c", "z"), ("c", "unknown")]
    shares = {"train": 40, "domain_balanced": 30, "distribution_shift": 30}
    state = split.unit_state(spark.createDataFrame(rows, "unit string, domain string"), 7, shares)
    state.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    domains = spark.createDataFrame([("x",), ("y",), ("z",)], "d string")
    part = {r[0]: r[1] for r in domains.select("d", split.domain_partition(F.col("d"), 7, shares)).collect()}
    got = {r["unit"]: tuple(r)[1:] for r in state.collect()}
    pair = sorted((part["x"], part["y"]))
    assert got == {"a": (2, *pair, False), "b": (1, None, None, True), "c": (2, part["z"], part["z"], True)}


def shard_rows(spark):
    """Predictions of two shards in each task, one of a task without scores and one without a task."""
    rows = [
        ("q1", "qa", "s0", "the red fox", "Red fox", None, None, None),
        ("q2", "qa", "s1", "blue", "green", None, None, None),
        ("g1", "grounding", "s0", "point: [15, 25]", None, None, [10.0, 20.0, 30.0, 40.0], [20.0, 30.0]),
        ("g2", "grounding", "s1", "no answer", None, None, [10.0, 20.0, 30.0, 40.0], [20.0, 30.0]),
        ("a1", "action", "s0", '{"thought":"t","action":{"name":"click","x":5,"y":5}}', None,
         '{"name":"click","x":5,"y":5}', [0.01, 0.01, 0.09, 0.09], None),
        ("a2", "action", "s1", "not json", None, '{"name":"go_back"}', None, None),
        ("x1", "other", "s0", "text", None, None, None, None),
        ("n1", None, "s1", "text", None, None, None, None),
    ]
    names = (
        "id string, task string, evaluation_label string, prediction string, answer string, "
        "target_action string, bbox_normalized array<double>, target_point_normalized array<double>"
    )
    return spark.createDataFrame(rows, names).withColumns(
        {
            "run_signature": F.col("evaluation_label"), "benchmark": F.lit("web"),
            "domain": F.col("id"), "website_category": F.lit("c"), "question_type": F.lit("reading"),
            "application_focused": F.lit(True), "image_width": F.lit(1000), "image_height": F.lit(500),
        }
    )


def merged_scores(spark, predictions, expected):
    shards = spark.createDataFrame(
        [("mixed", n, 2, "m", "r", f"/mnt/{n}/adapter", "h", ["/data/e.jsonl"]) for n in range(2)],
        "label string, shard_index int, num_shards int, model string, model_revision string, "
        "adapter string, adapter_sha256 string, manifests array<string>",
    )
    return evaluation.merge_and_score(expected, predictions, shards, "merged", "sig")


def test_merge_moves_scores_and_not_texts(spark, monkeypatch):
    stored = []

    def seen(function):
        def call(first, *columns, **options):
            made = function(first, *columns, **options)
            stored.append(set(made.columns))
            return made

        return call

    for name in ("cut", "cut_in_turn"):
        if hasattr(evaluation, name):
            monkeypatch.setattr(evaluation, name, seen(getattr(evaluation, name)))
    predictions = shard_rows(spark)
    expected = predictions.select("id", F.col("id").alias("order_key"))
    found = merged_scores(spark, predictions, expected)
    heavy = {"prediction", "answer", "target_action", "bbox_normalized", "parsed_action"}
    assert not any(heavy & columns for columns in stored)
    want = score.score_mixed_rows(align.merge_predictions(expected, predictions, "merged", "sig"))
    columns = score.score_columns(want)
    assert sorted(found["scored"].columns) == sorted(columns)
    got = sorted(map(repr, found["scored"].select(*columns).collect()))
    assert got == sorted(map(repr, want.select(*columns).collect()))
    assert len(got) == 6
    want = sorted(map(repr, score.score_mixed(want).collect()))
    assert sorted(map(repr, found["metrics"].collect())) == want


@pytest.mark.parametrize(("gone", "issue"), [("x1", "missing"), ("n1", "missing"), ("a1", "missing")])
def test_merge_misses_no_prediction_of_any_task(spark, gone, issue):
    predictions = shard_rows(spark)
    expected = predictions.select("id", F.col("id").alias("order_key"))
    with pytest.raises(align.CheckFailed, match=issue):
        merged_scores(spark, predictions.where(F.col("id") != gone), expected)
    with pytest.raises(align.CheckFailed, match="extra"):
        merged_scores(spark, predictions, expected.where(F.col("id") != gone))


def test_parts_are_stored_in_turn(spark):
    parts = [spark.range(0, 10), spark.range(0), spark.range(10, 25)]
    assert sorted(r["id"] for r in session.cut_in_turn(parts, codec="zstd").collect()) == list(range(25))
    assert session.cut_in_turn(parts[1:2]).count() == 0
