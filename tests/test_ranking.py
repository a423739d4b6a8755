import random
import statistics

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus.functions import hashing
from agentcorpus.operators import ranking


def skewed(spark, n=6000):
    """A third of all rows in one group."""
    group = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(n).select(
        "id", group.alias("k"), hashing.stable_key("r", F.col("id")).alias("h"),
        ((F.col("id") * F.col("id")) % 997 / F.lit(3.0)).alias("v"),
    )


def test_ranked_equals_a_plain_window(spark):
    rows = skewed(spark)
    plain = rows.withColumn("expected", F.row_number().over(W.partitionBy("k").orderBy("h")))
    got = ranking.ranked(rows, ["k"], [F.col("h")], hashing.key_prefix(F.col("h"), 2))
    joined = got.join(plain.select("id", "expected"), "id")
    assert joined.count() == 6000
    assert joined.where("rank <> expected").count() == 0
    limited = ranking.ranked(rows, ["k"], [F.col("h")], hashing.key_prefix(F.col("h"), 2), limit=40)
    assert {r["id"] for r in limited.collect()} == {
        r["id"] for r in plain.where("expected <= 40").collect()
    }


def test_position_bucket_is_exact(spark):
    rows = skewed(spark).where("id % 7 > 2")
    got = ranking.ranked(rows, ["k"], [F.col("id")], ranking.position_bucket(rows, "id", 64))
    plain = rows.withColumn("expected", F.row_number().over(W.partitionBy("k").orderBy("id")))
    assert got.join(plain.select("id", "expected"), "id").where("rank <> expected").count() == 0


def test_take_lowest_with_many_ties(spark):
    rows = skewed(spark).withColumn("v", F.floor(F.col("v") / 100) + 1.0)
    got = [r["id"] for r in ranking.take_lowest(rows, "v", 10.0, "h", 1234).orderBy("rank").collect()]
    expected = [r["id"] for r in rows.orderBy("v", "h").limit(1234).collect()]
    assert got == expected


def test_exact_median(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([0.0, 2.5, rng.uniform(0, 1e6)])) for g in "abcde" for _ in range(rng.randint(1, 60))]
    data.append(("z", None))
    rows = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r["m"] for r in ranking.exact_median(rows, ["g"], "v", "m").collect()}
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    overall = ranking.exact_median(rows, [], "v", "m").first()["m"]
    assert overall == statistics.median([v for _, v in data if v is not None])
