import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from agentcorpus.functions.hashing import digest
from agentcorpus.operators import records, sample, setops

from test_functions import python_hash


def make(spark, seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        domain = "hot.example" if i % 3 == 0 else f"d{rng.randint(0, 14)}.example"
        image = f"images/{rng.randint(0, 250)}.jpg"
        rows.append((f"r{i}", domain, rng.choice("aaaabbc"), image, "qa"))
    df = spark.createDataFrame(
        rows, "id string, domain string, website_category string, image string, task string"
    )
    return rows, records.with_unit(df)


def capped(rows, seed, per_unit):
    units = defaultdict(list)
    for row in rows:
        units["image:" + row[3]].append(row)
    out = []
    for unit, group in units.items():
        group.sort(key=lambda r: python_hash(seed, "record", r[0]))
        out += [(position, python_hash(seed, "unit", unit), r) for position, r in enumerate(group[:per_unit])]
    return units, out


def test_pool_and_natural_sample(spark):
    rows, df = make(spark)
    _, expected = capped(rows, 9, 2)
    by_domain = defaultdict(list)
    for position, key, row in expected:
        by_domain[row[1]].append((position, key, row[0]))
    ranks = {
        item[2]: i + 1 for items in by_domain.values() for i, item in enumerate(sorted(items))
    }
    got = {r["id"]: r["pool_rank"] for r in sample.unit_capped_pool(df, 9, 2).collect()}
    assert got == ranks
    for parts in (1, 50):
        natural = sample.natural_sample(df.repartition(parts), 40, 5, 1).orderBy("sample_rank")
        ids = [r["id"] for r in natural.collect()]
        units = [r["unit"] for r in natural.collect()]
        assert len(ids) == 40 == len(set(units))
        order = sorted(ids, key=lambda i: python_hash("evaluation-natural-sample", 5, i))
        assert ids == order


def test_temperature_sample_equals_the_greedy_schedule(spark):
    """Brute force: repeatedly take the domain with the least (taken + 1) / weight."""
    rows, df = make(spark)
    for count, temperature, share in ((60, 0.5, 0.2), (40, 0.0, 0.3), (50, 1.0, 0.5)):
        units, _ = capped(rows, 7, 1)
        pools = defaultdict(list)
        for unit, group in units.items():
            counts = Counter(r[1] for r in group)
            domain = min(counts, key=lambda d: (-counts[d], d))
            pools[domain].append((python_hash(7, "unit", unit), group[0][0]))
        cap = max(1, math.ceil(count * share))
        order = {d: [i for _, i in sorted(p)] for d, p in pools.items()}
        capacity = {d: min(len(p), cap) for d, p in order.items()}
        weight = {d: c**temperature if temperature else 1.0 for d, c in capacity.items()}
        taken, chosen = Counter(), []
        while len(chosen) < count:
            free = [d for d in capacity if taken[d] < capacity[d]]
            best = min(free, key=lambda d: ((taken[d] + 1) / weight[d], python_hash(7, "domain", d)))
            chosen.append(order[best][taken[best]])
            taken[best] += 1
        got = sample.temperature_sample(df, count, 7, temperature, share).orderBy("sample_rank")
        assert [r["id"] for r in got.collect()] == chosen
    with pytest.raises(sample.Infeasible):
        sample.temperature_sample(df, 400, 7, 0.5, 0.01)


def test_nested_tiers_keep_their_contract(spark):
    rows, df = make(spark)
    sizes = {"small": 30, "medium": 60, "large": 120}
    options = dict(
        seed=11, temperature=0.5, max_domain_share=0.25, max_per_unit=1,
        category_weights={"a": 4.0, "b": 1.0, "c": 0.5}, required_categories=["b", "c"],
        minimum_category_share=0.1,
    )
    tiers = sample.nested_tiers(df, sizes, **options)
    members = sample.tier_membership(tiers, list(sizes))
    assert setops.nested_check(members, list(sizes)).count() == 0
    held = defaultdict(list)
    for r in members.collect():
        held[r["tier"]].append(r)
    unit = {r[0]: r[3] for r in rows}
    for tier, size in sizes.items():
        assert len({r["id"] for r in held[tier]}) == size
        assert max(Counter(r["domain"] for r in held[tier]).values()) <= math.ceil(size * 0.25)
        categories = Counter(r["category"] for r in held[tier])
        assert min(categories["b"], categories["c"]) >= math.floor(size * 0.1)
        assert len({unit[r["id"]] for r in held[tier]}) == size
    again = sample.nested_tiers(df.repartition(37), sizes, **options)
    key = lambda r: (r["id"], r["tier"], r["pick_order"])
    assert sorted(map(key, again.collect())) == sorted(map(key, tiers.collect()))
    with pytest.raises(sample.Infeasible):
        sample.nested_tiers(df, sizes, seed=1, required_categories=["missing"])


def test_hash_first_and_quota(spark):
    _, df = make(spark)
    got = [r["id"] for r in sample.hash_select(df, 25, 4, "x").orderBy("sample_rank").collect()]
    ids = [r["id"] for r in df.collect()]
    assert got == sorted(ids, key=lambda i: python_hash(4, "x", i))[:25]
    with pytest.raises(sample.Infeasible):
        sample.require_rows(df.limit(3), 5, "few")
    split = df.withColumn("split", F.when(F.length("id") > 3, "train").otherwise("test"))
    filled = sample.quota_fill(split, {"train": 50, "test": 9}, {"train": 12, "test": 3}, 1, "q")
    rows = filled.collect()
    assert Counter(r["split"] for r in rows) == {"train": 50, "test": 9}
    assert max(Counter((r["split"], r["domain"]) for r in rows).values()) <= 12


def test_episode_ids_use_the_zero_separator(spark):
    import hashlib

    from agentcorpus.operators.study import episode_id

    got = spark.range(1).select(episode_id(F.lit("v"), F.lit("t"), F.lit(3)).alias("e")).first()["e"]
    assert got == hashlib.sha256(b"v\0t\x003").hexdigest()[:20]
    assert digest is not None
