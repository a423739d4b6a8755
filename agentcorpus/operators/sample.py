"""Deterministic, capped and nested samples.

Selections are closed-form: a rank inside each group gives every row a key, and the sample is the
rows with the lowest keys.  No loop over rows, no sequential greedy pass.  Ranks and cuts come from
:mod:`agentcorpus.operators.ranking`, so a dominant domain or unit never lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions import hashing
from agentcorpus.operators import records
from agentcorpus.operators.ranking import first_few, position_bucket, ranked, take_lowest
from agentcorpus.session import cut


class Infeasible(ValueError):
    """The requested sample cannot be drawn under its constraints."""


def unit_capped(df: DataFrame, seed: int, max_per_unit: int) -> DataFrame:
    """Keep ``max_per_unit`` rows per sampling unit by hash; adds ``position`` and ``unit_key``."""
    keyed = df.withColumn("_rk", hashing.stable_key(seed, "record", F.col("id")))
    kept = first_few(
        keyed, ["unit"], [F.col("_rk"), F.col("id")], max_per_unit, "position"
    ).drop("_rk")
    return kept.withColumn("position", F.col("position") - 1).withColumn(
        "unit_key", hashing.stable_key(seed, "unit", F.col("unit"))
    )


POOL_ORDER = ("position", "unit_key", "id")


def _pool_bucket() -> Column:
    # Never decreases along (position, unit_key, id).
    return F.col("position").cast("bigint") * 65536 + hashing.key_prefix(F.col("unit_key"), 4)


def unit_capped_pool(
    df: DataFrame, seed: int, max_per_unit: int, limit: int | None = None
) -> DataFrame:
    """Candidate order inside each domain: position in unit, then unit hash, then id.

    A unit that spans domains contributes each record to the record's own domain.
    """
    return ranked(
        unit_capped(df, seed, max_per_unit), ["domain"], [F.col(c) for c in POOL_ORDER],
        _pool_bucket(), "pool_rank", limit,
    )


def _majority_ranks(
    df: DataFrame, seed: int, max_per_unit: int, limit: int | None = None
) -> DataFrame:
    """Narrow rows (id, pool_domain, position, unit_key, pool_rank) of the pool below.

    The input is read once, for its narrow columns, which are stored; all ranks are taken of those.
    """
    narrow = cut(df, "id", "unit", "domain")
    counts = narrow.groupBy("unit", "domain").agg(F.count(F.lit(1)).alias("n"))
    home = counts.groupBy("unit").agg(
        F.min_by("domain", F.struct((-F.col("n")).alias("a"), F.col("domain"))).alias(
            "pool_domain"
        )
    )
    kept = cut(unit_capped(narrow.drop("domain"), seed, max_per_unit).join(home, "unit").drop("unit"))
    return ranked(
        kept, ["pool_domain"], [F.col(c) for c in POOL_ORDER], _pool_bucket(), "pool_rank", limit
    )


def majority_domain_pool(
    df: DataFrame, seed: int, max_per_unit: int, limit: int | None = None
) -> DataFrame:
    """Variant: a unit belongs wholly to its most common domain, ties alphabetical.

    Ids are unique; the wide columns of the ranked rows are joined last.
    """
    return df.join(_majority_ranks(df, seed, max_per_unit, limit), "id")


def domain_cap(count: int, share: float) -> int:
    return max(1, math.ceil(count * share))


def _weight(capacity: Column, temperature: float) -> Column:
    return F.pow(capacity.cast("double"), F.lit(float(temperature))) if temperature else F.lit(1.0)


def temperature_sample(
    df: DataFrame,
    count: int,
    seed: int,
    temperature: float = 0.5,
    max_domain_share: float = 0.02,
    max_per_unit: int = 1,
) -> DataFrame:
    """Sample ``count`` rows, domains scheduled by ``available ** temperature`` under a share cap.

    The r-th row of a domain of weight w has key r / w; the sample is the lowest keys, ties by the
    domain's hash.
    """
    cap = domain_cap(count, max_domain_share)
    pool = cut(_majority_ranks(df, seed, max_per_unit, cap))
    sizes = pool.groupBy("pool_domain").agg(F.max("pool_rank").alias("capacity"))
    available = sizes.agg(F.sum("capacity")).first()[0] or 0
    if available < count:
        raise Infeasible(f"constraints allow {available}/{count} rows")
    keyed = pool.join(sizes, "pool_domain").withColumns(
        {
            "key": F.round(
                F.col("pool_rank") / _weight(F.col("capacity"), temperature), 12
            ),
            "tie": F.concat(
                hashing.stable_key(seed, "domain", F.col("pool_domain")), F.lit(":"), F.col("id")
            ),
        }
    )
    high = float(cap) ** (1.0 - temperature) * 1.000001
    drawn = take_lowest(keyed, "key", high, "tie", count, "sample_rank")
    return df.join(drawn.select("id", "pool_domain", "sample_rank"), "id")


def _category_weight(category: Column, weights: Mapping[str, float]) -> Column:
    chain = None
    for name, weight in weights.items():
        if weight <= 0:
            raise ValueError("category weights must be positive")
        value = F.lit(float(weight))
        chain = F.when(category == name, value) if chain is None else chain.when(
            category == name, value
        )
    return F.lit(1.0) if chain is None else chain.otherwise(F.lit(1.0))


PAIR = ["domain", "category"]


def _before(pairs: DataFrame, amount: str) -> DataFrame:
    """Add ``_before``: the ``amount`` of the pairs of a domain that come earlier.

    Heavier categories come first.  A domain has one pair per category, a small vocabulary, so its
    prefix sums are built in one short array.
    """
    names = [c for c in pairs.columns if c != "domain"]
    key = F.struct((-F.col("category_weight")).alias("_w"), F.col("pair_key").alias("_k"), *names)
    domains = pairs.groupBy("domain").agg(F.array_sort(F.collect_list(key)).alias("_pairs"))
    before = F.transform(
        "_pairs",
        lambda pair, at: F.struct(
            *[pair[name].alias(name) for name in names],
            F.aggregate(
                F.slice("_pairs", F.lit(1), at), F.lit(0).cast("bigint"), lambda n, x: n + x[amount]
            ).alias("_before"),
        ),
    )
    return domains.select("domain", F.inline(before))


def diversity_pool(
    df: DataFrame,
    seed: int,
    largest: int,
    temperature: float,
    max_domain_share: float,
    max_per_unit: int,
    category_weights: Mapping[str, float],
) -> DataFrame:
    """Stored candidate pool: at most the largest tier's cap per (domain, category).

    No tier can use more rows of one domain than the cap, so the rest is left out before anything
    wide is sorted.  A row knows its rank in its (domain, category) and how many candidates that
    pair (``pair_size``) and the pairs before it (``_before``) hold; both come from the table of
    pair counts, so no row is ever ranked within a whole domain.
    """
    cap = domain_cap(largest, max_domain_share)
    category = records.field_or(df, "website_category", "unclassified")
    capped = unit_capped(df.withColumn("category", category), seed, max_per_unit)
    capped = cut(capped, "id", "domain", "category", "position", "unit_key")
    counts = capped.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    capacity = counts.groupBy("domain").agg(F.least(F.sum("n"), F.lit(cap)).alias("capacity"))
    pairs = counts.join(capacity, "domain").select(
        *PAIR,
        F.least(F.col("n"), F.lit(cap)).alias("pair_size"),
        _category_weight(F.col("category"), category_weights).alias("category_weight"),
        _weight(F.col("capacity"), temperature).alias("domain_weight"),
        hashing.stable_key(seed, "domain-category", *map(F.col, PAIR)).alias("pair_key"),
    )
    narrow = ranked(
        capped, PAIR, [F.col(c) for c in POOL_ORDER], _pool_bucket(), "pool_rank", cap
    ).drop("position", "unit_key")
    return cut(narrow.join(_before(pairs, "pair_size"), PAIR))


def _schedule(rows: DataFrame, taken: DataFrame | None, category: str | None, cap: int) -> DataFrame:
    """Key of every row left given what each domain already has.

    Inside a domain, heavier categories go first; the r-th pick of a domain has key
    r / (domain weight x category weight).  A pair is always taken from its first rank on, so
    ``taken``, its counts per pair, says which rows are left and how many come before a row.  Only
    rows of ``category``, where named, count; only those within the remaining cap are kept.
    """
    if taken is not None:
        left = F.col("pair_size") - F.col("_taken")
        pairs = rows.select(
            *PAIR, "pair_size", "category_weight", "pair_key"
        ).where(F.col("pool_rank") == 1).join(taken, PAIR, "left")
        pairs = pairs.withColumn("_taken", F.coalesce("_taken", F.lit(0)))
        used = pairs.groupBy("domain").agg(F.sum("_taken").alias("_used"))
        state = _before(pairs.withColumn("_left", left).drop("pair_size"), "_left").join(used, "domain")
        state = state.select(*PAIR, "_taken", "_used", F.col("_before").alias("_earlier"))
        rows = rows.drop("_before").join(state, PAIR).where(F.col("pool_rank") > F.col("_taken"))
        earlier = F.lit(0) if category else F.col("_earlier")
        turn = F.col("_used") + earlier + F.col("pool_rank") - F.col("_taken")
    else:
        turn = (F.lit(0) if category else F.col("_before")) + F.col("pool_rank")
    if category:
        rows = rows.where(F.col("category") == category)
    keyed = rows.withColumn("turn", turn).where(F.col("turn") <= cap)
    return keyed.select(
        "id",
        *PAIR,
        F.round(F.col("turn") / (F.col("domain_weight") * F.col("category_weight")), 12).alias("key"),
        F.concat("pair_key", F.lit(":"), "id").alias("tie"),
    )


def nested_tiers(
    df: DataFrame,
    sizes: Mapping[str, int],
    seed: int,
    temperature: float = 0.5,
    max_domain_share: float = 0.02,
    max_per_unit: int = 1,
    category_weights: Mapping[str, float] | None = None,
    required_categories: Sequence[str] = (),
    minimum_category_share: float = 0.0,
) -> DataFrame:
    """Tiers of growing size, each holding the one before: (id, domain, category, tier, pick_order).

    ``tier`` is the smallest tier a row belongs to.  Every tier keeps each domain within
    ``ceil(size x share)`` rows and every required category at or above ``floor(size x minimum)``.
    Per tier: rows of the previous tier stay, required categories are filled scarcest first, and the
    rest goes by key under the same remaining cap.  That is a fixed number of jobs per tier.
    """
    counts = list(sizes.values())
    if any(b <= a for a, b in zip(counts, counts[1:])) or not counts or counts[0] <= 0:
        raise ValueError("tier sizes must be positive and strictly increasing")
    required = sorted(set(required_categories))
    if minimum_category_share * len(required) > 1:
        raise ValueError("minimum category shares exceed the sample")
    pool = diversity_pool(
        df, seed, counts[-1], temperature, max_domain_share, max_per_unit,
        dict(category_weights or {}),
    )
    supply: dict[str, int] = {}
    if required:
        found = pool.where(F.col("category").isin(required)).groupBy("category").count().collect()
        supply = {row["category"]: row["count"] for row in found}
        missing = [name for name in required if name not in supply]
        if missing:
            raise Infeasible(f"required categories have no candidates: {missing}")
    lightest = min([1.0, *(category_weights or {}).values()])
    picks: list[DataFrame] = []
    held = dict.fromkeys(required, 0)
    total = 0

    def add(category: str | None, tier: str, count: int, cap: int) -> int:
        nonlocal total
        taken = None
        if picks:
            chosen = reduce(DataFrame.unionByName, picks)
            taken = chosen.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_taken"))
        ready = cut(_schedule(pool, taken, category, cap))
        # A domain's weight is at least one, so no key exceeds the cap over the lightest category.
        lowest = take_lowest(ready, "key", cap / lightest * 1.000001, "tie", count, "pick")
        order = (F.col("pick") + total).cast("bigint").alias("pick_order")
        picked = cut(lowest.select("id", *PAIR, F.lit(tier).alias("tier"), order))
        # one row: the size of the pick and of the required categories in it
        sizes = [F.count_if(F.col("category") == name) for name in required]
        added, *found = picked.agg(F.count(F.lit(1)), *sizes).first()
        for name, n in zip(required, found):
            held[name] += n
        picks.append(picked)
        total += added
        return added

    for tier, size in sizes.items():
        cap = domain_cap(size, max_domain_share)
        for category in sorted(required, key=lambda name: (supply[name], name)):
            need = math.floor(size * minimum_category_share) - held[category]
            if need > 0 and add(category, tier, need, cap) < need:
                raise Infeasible(f"category floor of {category} cannot be met in {tier}")
        if size > total:
            add(None, tier, size - total, cap)
        if total < size:
            raise Infeasible(f"constraints allow {total}/{size} rows in {tier}")
    return reduce(DataFrame.unionByName, picks)


def diverse_sample(df: DataFrame, count: int, **options) -> DataFrame:
    """One tier of :func:`nested_tiers`."""
    return nested_tiers(df, {"sample": count}, **options)


def tier_membership(tiers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Expand the smallest-tier column: a row per (tier, id) for each tier that holds the id."""
    names = F.array(*[F.lit(name) for name in order])
    start = F.array_position(names, F.col("tier"))
    return tiers.select(
        F.explode(F.slice(names, start.cast("int"), F.lit(len(order)))).alias("tier"),
        "id", "domain", "category", "pick_order",
    )


def tier_audit(
    members: DataFrame, max_domain_share: float, required: Sequence[str], minimum: float
) -> DataFrame:
    """Per tier: size, top domain share, lowest required-category share, and whether both hold."""
    domains = members.groupBy("tier", "domain").agg(F.count(F.lit(1)).alias("n"))
    per_tier = domains.groupBy("tier").agg(
        F.sum("n").alias("examples"), F.count(F.lit(1)).alias("domains"),
        F.max("n").alias("_top"),
    )
    floors = [
        F.count_if(F.col("category") == name).alias(f"_c{i}") for i, name in enumerate(required)
    ]
    lowest = F.lit(None).cast("bigint")
    if len(floors) == 1:
        lowest = F.col("_c0")
    elif floors:
        lowest = F.least(*[F.col(f"_c{i}") for i in range(len(floors))])
    cats = members.groupBy("tier").agg(*(floors or [F.lit(0).alias("_none")]))
    share = F.col("_top") / F.col("examples")
    slack = F.lit(1.0) / F.col("examples")
    floor_share = lowest / F.col("examples")
    return per_tier.join(cats, "tier").select(
        "tier", "examples", "domains",
        share.alias("max_domain_share"),
        floor_share.alias("min_required_share"),
        (share <= F.lit(max_domain_share) + slack).alias("cap_ok"),
        F.coalesce(floor_share + slack >= F.lit(minimum), F.lit(True)).alias("floor_ok"),
    )


def natural_sample(df: DataFrame, count: int, seed: int, max_per_unit: int) -> DataFrame:
    """Unit cap by hash, then the first ``count`` rows in global hash order."""
    keyed = df.withColumn(
        "_rk", hashing.stable_key("evaluation-natural-record", seed, F.col("unit"), F.col("id"))
    )
    capped = first_few(keyed, ["unit"], [F.col("_rk"), F.col("id")], max_per_unit).drop(
        "_rk", "rank"
    )
    return hash_first(capped, count, "evaluation-natural-sample", seed)


def hash_first(df: DataFrame, count: int, *salt) -> DataFrame:
    """The ``count`` rows with the lowest hash, without sending candidates to one task."""
    key = hashing.stable_key(*salt, F.col("id"))
    keyed = df.withColumn("_hk", key)
    return ranked(
        keyed, [], [F.col("_hk"), F.col("id")], hashing.key_prefix(F.col("_hk"), 4),
        "sample_rank", count,
    ).drop("_hk")


def hash_select(df: DataFrame, count: int, seed: int, label: str) -> DataFrame:
    return hash_first(df, count, seed, label)


def require_rows(df: DataFrame, count: int, label: str) -> DataFrame:
    """Explicit check: stores the sample and raises when it is short."""
    kept = cut(df)
    found = kept.count()
    if found < count:
        raise Infeasible(f"need {count} {label} rows, found {found}")
    return kept


def suite_sample(
    df: DataFrame, suite: str, task: str, count: int, seed: int, sampling: Mapping
) -> DataFrame:
    """Natural or diverse sample of one suite and task, with per-task overrides."""
    per_unit = 3 if task == "qa" else 1
    if suite in set(sampling.get("natural_suites") or ()):
        return natural_sample(df, count, seed, per_unit).select("id", "sample_rank")
    override = dict((sampling.get("task_overrides") or {}).get(task) or {})
    minimum = override.get(
        "minimum_category_share", sampling.get("minimum_category_share", 0.0)
    )
    picked = diverse_sample(
        df, count, seed=seed,
        temperature=float(sampling.get("temperature", 0.25)),
        max_domain_share=float(sampling.get("max_domain_share", 0.02)),
        max_per_unit=per_unit,
        category_weights=dict(sampling.get("category_weights") or {}),
        required_categories=list(sampling.get("required_categories") or []),
        minimum_category_share=float(minimum),
    )
    return picked.select("id", F.col("pick_order").alias("sample_rank"))


def stratified_sample(df: DataFrame, seed: int, per_stratum: int) -> DataFrame:
    """Lowest ``per_stratum`` ranks of each (task, category)."""
    keyed = df.withColumns(
        {
            "stratum_task": records.field_or(df, "task"),
            "stratum_category": records.field_or(df, "website_category", "general_web"),
            "stable_rank": hashing.stable_rank(seed, F.col("id")),
        }
    )
    keys = ["stratum_task", "stratum_category"]
    return ranked(
        keyed, keys, [F.col("stable_rank")], hashing.key_prefix(F.col("stable_rank"), 3),
        limit=per_stratum,
    )


def quota_fill(
    df: DataFrame, targets: Mapping[str, int], caps: Mapping[str, int] | None, *salt
) -> DataFrame:
    """Per split: at most ``caps`` rows of a domain, then ``targets`` rows, both in hash order.

    The input is read once for its narrow columns, which are stored and cut twice by histograms of
    the hash, and once for the wide columns of the rows that fill the quotas.  Ids are unique.
    """

    def by_split(values):
        chain = None
        for split, value in values.items():
            amount = F.lit(int(value))
            chain = F.when(F.col("split") == split, amount) if chain is None else chain.when(
                F.col("split") == split, amount
            )
        return chain.otherwise(F.lit(0))

    names = ["split", "domain"] if caps is not None else ["split"]
    keyed = cut(df.select("id", *names, hashing.stable_key(*salt, F.col("id")).alias("_hk")))
    order, bucket = [F.col("_hk"), F.col("id")], hashing.key_prefix(F.col("_hk"), 3)
    if caps is not None:
        keyed = ranked(keyed, ["split", "domain"], order, bucket, "_in", max(caps.values()))
        keyed = cut(keyed.where(F.col("_in") <= by_split(caps)), "id", "split", "_hk")
    filled = ranked(keyed, ["split"], order, bucket, "split_rank", max(targets.values()))
    filled = filled.where(F.col("split_rank") <= by_split(targets))
    return df.join(filled.select("id", "split_rank"), "id")


def quota_gaps(filled: DataFrame, targets: DataFrame) -> DataFrame:
    """Splits whose target was not reached; empty when every quota is filled."""
    have = filled.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("target") - F.coalesce("n", F.lit(0))
    return targets.join(have, "split", "left").select("split", gap.alias("missing")).where(
        "missing > 0"
    )


def prefix_take(df: DataFrame, order_key: str, count: int) -> DataFrame:
    """First ``count`` rows of an ordered manifest."""
    return ranked(
        df, [], [F.col(order_key)], position_bucket(df, order_key), "prefix_rank", count
    )


def seeded_shuffle(df: DataFrame, *salt) -> DataFrame:
    """Reproducible order: a range-partitioned sort on the seeded hash, plus that hash."""
    keyed = df.withColumn("shuffle_key", hashing.stable_key(*salt, F.col("id")))
    return keyed.orderBy("shuffle_key", "id")


def representative_errors(df: DataFrame, bucket: Column, per_bucket: int) -> DataFrame:
    """First rows of each error bucket by hash; ``…correct`` buckets hold at most ten."""
    keyed = df.withColumn("bucket", bucket)
    keyed = keyed.withColumn("_hk", hashing.stable_key(F.col("id"), F.col("bucket")))
    picked = first_few(keyed, ["bucket"], [F.col("_hk"), F.col("id")], per_bucket)
    limit = F.when(F.col("bucket").endswith("correct"), F.lit(min(per_bucket, 10))).otherwise(
        F.lit(per_bucket)
    )
    return picked.where(F.col("rank") <= limit).drop("_hk")


LEAST_ARCHIVED = 32


def retain_archived(
    df: DataFrame, images: DataFrame, order: Sequence[Column], limit: int = 64
) -> DataFrame:
    """First ``limit`` rows whose image is archived.

    Fewer than ``min(limit, LEAST_ARCHIVED)`` of them are an error, raised by the job that counts the
    few rows kept.
    """
    kept = df.join(images.select("image").distinct(), "image", "left_semi")
    return require_rows(kept.orderBy(*order).limit(limit), min(limit, LEAST_ARCHIVED), "archived")
