import pytest
from pyspark.sql import functions as F

from agentcorpus.functions import web
from agentcorpus.operators import align, study
from agentcorpus.sources import scans

MANIFEST = (
    "study_id string, run_id string, suite_id string, config_sha256 string, shard_index int, "
    "num_shards int, status string"
)


def shards(spark, n=3, **changes):
    rows = [["s", "r", "t", "c", i, n, "complete"] for i in range(n)]
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    for name, value in changes.items():
        rows[1][names.index(name)] = value
    return spark.createDataFrame(rows, MANIFEST)


def runs(spark):
    rows = [
        (f"{v}-{t}", v, f"t{t}", t % 2, t % 3 == 0 if v == "a" else t % 2 == 0, float(t), t, 0)
        for v in ("a", "b") for t in range(24)
    ]
    return spark.createDataFrame(
        rows, "episode_id string, variant_id string, task_id string, seed int, success boolean, "
        "total_reward double, steps_taken int, parse_errors int",
    )


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_merged_shards_equal_the_whole(spark):
    whole = runs(spark)
    merged = study.merge_shards(shards(spark), whole.repartition(7))
    assert {r["merged_shards"] for r in merged.collect()} == {3}
    assert plain(study.variant_summary(merged)) == plain(study.variant_summary(whole))
    assert plain(study.compare_variants(merged, "a", ["b"], 50, 1)) == plain(
        study.compare_variants(whole, "a", ["b"], 50, 1)
    )
    assert study.merge_shards(shards(spark), whole.limit(0)).count() == 0


@pytest.mark.parametrize(
    "changes,message",
    [
        ({"status": "running"}, "must be complete"), ({"status": None}, "must be complete"),
        ({"shard_index": 0}, "missing or repeated"), ({"shard_index": 3}, "missing or repeated"),
        ({"num_shards": 4}, "missing or repeated"), ({"config_sha256": "d"}, "disagree"),
        ({"study_id": None}, "disagree"), ({"suite_id": "u"}, "disagree"), ({"run_id": "q"}, "disagree"),
    ],
)
def test_shards_that_do_not_fit(spark, changes, message):
    merged = study.merge_shards(shards(spark, **changes), runs(spark))
    with pytest.raises(Exception, match=message):
        merged.collect()


def test_missing_manifests_and_repeated_episodes(spark):
    with pytest.raises(Exception, match="no study shard manifests"):
        study.merge_shards(shards(spark).limit(0), runs(spark)).collect()
    twice = runs(spark).unionByName(runs(spark).where("episode_id = 'b-3'"))
    with pytest.raises(Exception, match="duplicate episode b b-3"):
        study.merge_shards(shards(spark), twice).collect()


def test_counts_of_the_writing_pass(spark, tmp_path):
    reasons = ["malformed_row", None, "no_valid_examples", None, "odd", None]
    rows = spark.createDataFrame(list(enumerate(reasons * 50)), "id int, reason string").repartition(5)
    counts = scans.write_scanned(rows, str(tmp_path / "kept"))
    assert counts == {"rows": 300, "accepted": 150, "malformed_row": 50, "no_valid_examples": 50, "other": 50}
    assert spark.read.parquet(str(tmp_path / "kept")).columns == ["id"]
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 150


def test_bucketed_index_is_not_shuffled(spark, tmp_path):
    index = spark.range(500).select(
        F.concat(F.lit("l"), "id").alias("locator_id"), F.col("id").cast("string").alias("image"),
        F.lit(1).alias("image_width"), F.lit(1).alias("image_height"), F.lit("x").alias("jpeg_sha256"),
        F.lit(2).alias("jpeg_bytes"),
    )
    manifest = spark.range(900).select(F.col("id").alias("record"), F.concat(F.lit("l"), "id").alias("locator_id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = align.store_image_index(index, "image_index_test", str(tmp_path / "index"), 8)
        joined = align.materialize_manifest(manifest, stored)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert sorted(map(tuple, joined.collect())) == sorted(
            map(tuple, align.materialize_manifest(manifest, index).collect())
        )
        missing = align.unmaterialized(manifest, stored)
        assert missing._jdf.queryExecution().executedPlan().toString().count("Bucketed: true") == 1
        assert missing.count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table if exists image_index_test")


RULES = [
    ("", "skipped"), ("*.bank.example", "service_application"), ("shop.*", "transactional_application"),
    ("exact.example", "a"), ("*mid*", "b"), ("x?z.example", "c"), ("[ab]c.example", "d"),
    ("utm=1", "e"), ("*", "f"), ("a*z.example", "g"), ("EXACT.example", "h"), (None, "i"),
]
PLACES = [
    ("my.bank.example", "s", ""), ("bank.example", "bank.example", "http://bank.example/*.bank.example"),
    ("shop.example", "s", None), ("q", "shop.x", ""), ("exact.example", "s", ""), ("exact.examples", "s", ""),
    ("a-mid-b", "s", ""), ("xyz.example", "s", "utm=1"), ("bc.example", "s", ""), ("q", "s", "x?utm=1"),
    ("abcz.example", "s", "news"), ("q", "s", ""), ("unknown", "", "https://x/shop"), ("exact.example", None, ""),
]


@pytest.mark.parametrize("rules", [RULES, [r for r in RULES if r[0] != "*"], [("", "x")], RULES[::-1]])
def test_rule_table_gives_the_same_verdicts(spark, rules):
    rows = spark.createDataFrame(PLACES * 3, "d string, s string, u string").repartition(4)
    places = [F.col("d"), F.col("s"), F.col("u")]
    both = rows.select(
        "*", web.classify_website(*places, rules).alias("a"), web.classify_website(*places, rules, True).alias("b")
    ).collect()
    assert len(both) == len(PLACES) * 3
    for r in both:
        assert r["a"] == r["b"], r
