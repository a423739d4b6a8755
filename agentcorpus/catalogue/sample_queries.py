"""Deterministic samples and their audits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, r6, rounded, sql_key, table
from agentcorpus.catalogue.split_queries import SPLIT_SQL, split_documents
from agentcorpus.operators import records, sample, setops
from agentcorpus.session import cut

SEED = B.SEED


def units(spark, folder):
    return records.with_unit(B.document_records(spark, folder))


def capped_sql(per_unit: int) -> str:
    return f"""
r AS ({B.DOCUMENTS_SQL}),
k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY
        {sql_key(f"'{SEED}'", "'record'", 'id')}, id) - 1 AS position,
        {sql_key(f"'{SEED}'", "'unit'", 'unit')} AS unit_key FROM r),
k1 AS (SELECT * FROM k WHERE position < {per_unit})
"""


@query(
    "unit_capped_pool",
    f"""WITH {capped_sql(2)} SELECT id, domain, position::INT AS position,
        row_number() OVER (PARTITION BY domain ORDER BY position, unit_key, id)::BIGINT AS pool_rank
        FROM k1""",
)
def unit_capped_pool(spark, folder):
    return sample.unit_capped_pool(units(spark, folder), SEED, 2).select(
        "id", "domain", F.col("position").cast("int").alias("position"),
        F.col("pool_rank").cast("bigint").alias("pool_rank"),
    )


MAJORITY_SQL = """
h AS (SELECT unit, domain AS pool_domain FROM (SELECT unit, domain, row_number() OVER (
        PARTITION BY unit ORDER BY count(*) DESC, domain) AS rn FROM r GROUP BY unit, domain)
      WHERE rn = 1),
p AS (SELECT k1.*, pool_domain, row_number() OVER (PARTITION BY pool_domain
        ORDER BY position, unit_key, id) AS pool_rank FROM k1 JOIN h USING (unit))
"""


@query(
    "majority_domain_pool",
    f"""WITH {capped_sql(1)}, {MAJORITY_SQL}
        SELECT id, pool_domain, pool_rank::BIGINT AS pool_rank FROM p""",
)
def majority_domain_pool(spark, folder):
    return sample.majority_domain_pool(units(spark, folder), SEED, 1).select(
        "id", "pool_domain", F.col("pool_rank").cast("bigint").alias("pool_rank")
    )


@query(
    "temperature_sample",
    f"""WITH {capped_sql(1)}, {MAJORITY_SQL},
    c AS (SELECT pool_domain, least(count(*), 32) AS capacity FROM p GROUP BY pool_domain)
    SELECT id, pool_domain, row_number() OVER (ORDER BY key, dk, id)::BIGINT AS sample_rank
    FROM (SELECT id, pool_domain, round(pool_rank / pow(capacity::DOUBLE, 0.5), 12) AS key,
            {sql_key(f"'{SEED}'", "'domain'", 'pool_domain')} AS dk
          FROM p JOIN c USING (pool_domain) WHERE pool_rank <= capacity)
    QUALIFY sample_rank <= 400""",
)
def temperature_sample(spark, folder):
    drawn = sample.temperature_sample(
        units(spark, folder), 400, SEED, temperature=0.5, max_domain_share=0.08
    )
    return drawn.select("id", "pool_domain", F.col("sample_rank").cast("bigint"))


WEIGHTS = {"en": 4.0, "fr": 1.0, "de": 1.0, "es": 0.5}
TIERS = {"small": 60, "medium": 150, "large": 300}


def _tiers(spark, folder):
    return sample.nested_tiers(
        units(spark, folder), TIERS, SEED, temperature=0.5, max_domain_share=0.15,
        max_per_unit=1, category_weights=WEIGHTS, required_categories=["de", "es", "fr"],
        minimum_category_share=0.12,
    )


@query(
    "diverse_sample",
    f"""WITH {capped_sql(1)},
    p AS (SELECT id, domain, website_category AS category, row_number() OVER (PARTITION BY domain,
        website_category ORDER BY position, unit_key, id) AS pool_rank FROM k1),
    w AS (SELECT domain, least(count(*), 60) AS capacity FROM k1 GROUP BY domain),
    t AS (SELECT p.*, pow(capacity::DOUBLE, 0.5) AS dw, CASE category WHEN 'en' THEN 4.0::DOUBLE
        WHEN 'es' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS cw,
        {sql_key(f"'{SEED}'", "'domain-category'", 'domain', 'category')} AS pk
        FROM p JOIN w USING (domain) WHERE pool_rank <= 60),
    s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cw DESC, pk, pool_rank, id)
        AS turn FROM t)
    SELECT id, domain, category, row_number() OVER (ORDER BY round(turn / (dw * cw), 12), pk, id)
      ::BIGINT AS pick_order FROM s WHERE turn <= 60 QUALIFY pick_order <= 300""",
)
def diverse_sample(spark, folder):
    """Without floors the closed form is one order, which SQL can state."""
    return sample.diverse_sample(
        units(spark, folder), 300, seed=SEED, temperature=0.5, max_domain_share=0.2,
        max_per_unit=1, category_weights=WEIGHTS,
    ).select("id", "domain", "category", "pick_order")


def tiers_sql(
    capped: str, sizes: dict[str, int], seed: int, temperature: float, share: float,
    required: tuple[str, ...], minimum: float,
) -> str:
    """CTEs up to ``chosen``: one pick after the other, each over all rows that the ones before left.

    ``capped`` names the unit-capped rows.  Floors are filled scarcest category first.
    """
    largest = max(1, math.ceil(max(sizes.values()) * share))
    weight = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())
    ctes = [
        f"""tp AS MATERIALIZED (SELECT id, domain, website_category AS category,
          row_number() OVER (PARTITION BY domain, website_category ORDER BY position, unit_key, id)
            AS pool_rank,
          pow(least(count(*) OVER (PARTITION BY domain), {largest})::DOUBLE, {temperature}) AS dw,
          {sql_key(f"'{seed}'", "'domain-category'", 'domain', 'website_category')} AS pk
          FROM {capped} QUALIFY pool_rank <= {largest})""",
        f"tpool AS MATERIALIZED (SELECT *, {weight} ELSE 1.0::DOUBLE END AS cw FROM tp)",
        """supply AS MATERIALIZED (SELECT category, row_number() OVER (ORDER BY count(*), category) AS nth
          FROM tpool WHERE category IN ("""
        + ", ".join(f"'{name}'" for name in required)
        + ") GROUP BY category)",
        """chosen0 AS MATERIALIZED (SELECT id, domain, category, '' AS tier, 0::BIGINT AS pick_order
          FROM tpool WHERE false)""",
    ]
    at = 0
    for tier, size in sizes.items():
        cap = max(1, math.ceil(size * share))
        for nth in (*range(1, len(required) + 1), 0):  # 0: the rest, of all categories
            before, at = f"chosen{at}", at + 1
            kind = f"AND category = (SELECT category FROM supply WHERE nth = {nth})" if nth else ""
            floor = math.floor(size * minimum)
            need = (
                f"{floor} - (SELECT count(*) FROM {before} JOIN supply USING (category) WHERE nth = {nth})"
                if nth
                else f"{size} - (SELECT count(*) FROM {before})"
            )
            ctes += [
                f"""turns{at} AS MATERIALIZED (SELECT t.*, coalesce(u.used, 0) + row_number() OVER (
                  PARTITION BY t.domain ORDER BY cw DESC, pk, pool_rank, id) AS turn FROM tpool t
                  LEFT JOIN (SELECT domain, count(*) AS used FROM {before} GROUP BY domain) u
                    ON u.domain = t.domain
                  WHERE id NOT IN (SELECT id FROM {before}) {kind})""",
                f"""chosen{at} AS MATERIALIZED (SELECT * FROM {before} UNION ALL
                  SELECT id, domain, category, '{tier}',
                    (SELECT count(*) FROM {before}) + rn FROM (SELECT *, row_number() OVER (
                      ORDER BY round(turn / (dw * cw), 12), pk, id) AS rn
                    FROM turns{at} WHERE turn <= {cap}) WHERE rn <= {need})""",
            ]
    return ",\n".join([*ctes, f"chosen AS (SELECT * FROM chosen{at})"])


TIERS_SQL = f"""WITH {capped_sql(1)},
{tiers_sql('k1', TIERS, SEED, 0.5, 0.15, ("de", "es", "fr"), 0.12)}"""


@query("nested_tiers", f"{TIERS_SQL} SELECT id, domain, category, tier, pick_order FROM chosen")
def nested_tiers(spark, folder):
    """Floors make the tiers depend on one another: the twin repeats every pick over all rows."""
    return _tiers(spark, folder)


@query(
    "nested_tier_sizes",
    f"""{TIERS_SQL},
    tier_order AS (SELECT * FROM (VALUES ('small', 1), ('medium', 2), ('large', 3)) v(tier, nth)),
    members AS (SELECT o.tier, c.domain, c.category FROM chosen c
      JOIN tier_order s ON s.tier = c.tier JOIN tier_order o ON o.nth >= s.nth),
    tops AS (SELECT tier, max(n) AS top FROM (SELECT tier, domain, count(*) AS n FROM members
      GROUP BY tier, domain) GROUP BY tier)
    SELECT tier, count(*)::BIGINT AS examples, max(top) / count(*) <= 0.15 + 1.0 / count(*) AS cap_ok,
      least(count(*) FILTER (WHERE category = 'de'), count(*) FILTER (WHERE category = 'es'),
            count(*) FILTER (WHERE category = 'fr')) / count(*) + 1.0 / count(*) >= 0.12 AS floor_ok
    FROM members JOIN tops USING (tier) GROUP BY tier""",
)
def nested_tier_sizes(spark, folder):
    """The published contract, counted: exact sizes, cap and floors held in every tier."""
    members = cut(sample.tier_membership(_tiers(spark, folder), list(TIERS)))
    return sample.tier_audit(members, 0.15, ["de", "es", "fr"], 0.12).select(
        "tier", "examples", "cap_ok", "floor_ok"
    )


_NESTING = """
t AS (SELECT doc_id::VARCHAR AS id, source AS domain, n_chars % 10 AS k, doc_id % 7 = 0 AS hole FROM documents),
m AS (SELECT 'small' AS tier, id, domain FROM t WHERE k < 2 UNION ALL
      SELECT 'medium', id, domain FROM t WHERE k < 5 AND NOT hole UNION ALL
      SELECT 'large', id, domain FROM t WHERE k <> 4)"""


def nesting(spark, folder):
    """Tiers by text length, with holes: the middle one lacks every seventh id, the last one length 4."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("domain"),
        (F.col("n_chars") % 10).alias("k"), (F.col("doc_id") % 7 == 0).alias("hole"),
    )
    tiers = F.array_compact(
        F.array(
            F.when(F.col("k") < 2, "small"),
            F.when((F.col("k") < 5) & ~F.col("hole"), "medium"),
            F.when(F.col("k") != 4, "large"),
        )
    )
    return docs.select("id", "domain", F.explode(tiers).alias("tier"))


@query(
    "nested_check",
    f"""WITH {_NESTING} SELECT id, 'small' AS missing_after FROM m WHERE tier = 'small' AND id NOT IN
      (SELECT id FROM m WHERE tier = 'medium') UNION ALL
    SELECT id, 'medium' FROM m WHERE tier = 'medium' AND id NOT IN
      (SELECT id FROM m WHERE tier = 'large')""",
)
def nested_check(spark, folder):
    return setops.nested_check(nesting(spark, folder), ["small", "medium", "large"])


@query(
    "natural_sample",
    f"""WITH r AS ({B.DOCUMENTS_SQL}),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY
      {sql_key("'evaluation-natural-record'", f"'{SEED}'", 'unit', 'id')}, id) AS rn FROM r)
    SELECT id, row_number() OVER (ORDER BY
      {sql_key("'evaluation-natural-sample'", f"'{SEED}'", 'id')}, id)::BIGINT AS sample_rank
    FROM k WHERE rn <= 1 QUALIFY sample_rank <= 256""",
)
def natural_sample(spark, folder):
    return sample.natural_sample(units(spark, folder), 256, SEED, 1).select(
        "id", F.col("sample_rank").cast("bigint")
    )


SUITE_SQL = f"""
WITH r AS ({B.DOCUMENTS_SQL}),
n AS (SELECT id, row_number() OVER (PARTITION BY unit ORDER BY
    {sql_key("'evaluation-natural-record'", f"'{SEED}'", 'unit', 'id')}, id) AS rn
  FROM r WHERE task = 'qa'),
k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY
    {sql_key(f"'{SEED + 1}'", "'record'", 'id')}, id) - 1 AS position,
    {sql_key(f"'{SEED + 1}'", "'unit'", 'unit')} AS unit_key FROM r WHERE task = 'grounding'),
k1 AS (SELECT * FROM k WHERE position < 1),
{tiers_sql('k1', {"sample": 100}, SEED + 1, 0.25, 0.1, ("de", "fr"), 0.05)}
SELECT 'domain_balanced' AS suite, 'grounding' AS task, id, pick_order AS sample_rank FROM chosen
UNION ALL
SELECT 'iid', 'qa', id, sample_rank FROM (SELECT id, row_number() OVER (ORDER BY
    {sql_key("'evaluation-natural-sample'", f"'{SEED}'", 'id')}, id)::BIGINT AS sample_rank
  FROM n WHERE rn <= 3) WHERE sample_rank <= 100
"""


@query("suite_sample", SUITE_SQL)
def suite_sample(spark, folder):
    """A natural suite for one task and a diverse one for another, from one configuration."""
    rows = units(spark, folder)
    sampling = {
        "natural_suites": ["iid"], "temperature": 0.25, "max_domain_share": 0.1,
        "category_weights": WEIGHTS, "required_categories": ["de", "fr"],
        "minimum_category_share": 0.05, "task_overrides": {"qa": {"minimum_category_share": 0.02}},
    }
    parts = [
        sample.suite_sample(rows.where(F.col("task") == task), suite, task, 100, SEED + i, sampling)
        .select(F.lit(suite).alias("suite"), F.lit(task).alias("task"), "id",
                F.col("sample_rank").cast("bigint"))
        for i, (suite, task) in enumerate((("iid", "qa"), ("domain_balanced", "grounding")))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stratified_sample",
    f"""WITH r AS ({B.DOCUMENTS_SQL}) SELECT id, task AS stratum_task,
      website_category AS stratum_category, sha256('{SEED}:' || id) AS stable_rank FROM r
      QUALIFY row_number() OVER (PARTITION BY task, website_category
        ORDER BY sha256('{SEED}:' || id)) <= 4""",
)
def stratified_sample(spark, folder):
    return sample.stratified_sample(B.document_records(spark, folder), SEED, 4).select(
        "id", "stratum_task", "stratum_category", "stable_rank"
    )


TARGETS = {"train": 500, "validation": 60, "test": 40}
CAPS = {"train": 40, "validation": 25, "test": 20}


def _by_split(values) -> str:
    return "CASE split " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


QUOTA_SQL = f"""
d AS (SELECT *, {sql_key(f"'{SEED}'", "'quota'", 'id')} AS hk FROM ({SPLIT_SQL})),
c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY split, domain ORDER BY hk, id)
      <= {_by_split(CAPS)}),
f AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY hk, id)::BIGINT AS split_rank FROM c
      QUALIFY split_rank <= {_by_split(TARGETS)})
"""


def _quota(spark, folder):
    return sample.quota_fill(split_documents(spark, folder), TARGETS, CAPS, SEED, "quota")


@query("quota_fill", f"WITH {QUOTA_SQL} SELECT id, split, domain, split_rank FROM f")
def quota_fill(spark, folder):
    return _quota(spark, folder).select(
        "id", "split", "domain", F.col("split_rank").cast("bigint")
    )


@query(
    "quota_gaps",
    f"""WITH {QUOTA_SQL}, t AS (SELECT * FROM (VALUES ('train', 900::BIGINT), ('validation',
        60::BIGINT), ('test', 200::BIGINT)) v(split, target))
    SELECT split, target - coalesce(n, 0) AS missing FROM t
      LEFT JOIN (SELECT split, count(*) AS n FROM f GROUP BY split) USING (split)
    WHERE target > coalesce(n, 0)""",
)
def quota_gaps(spark, folder):
    wanted = spark.createDataFrame(
        [("train", 900), ("validation", 60), ("test", 200)], "split string, target bigint"
    )
    return sample.quota_gaps(_quota(spark, folder), wanted)


@query(
    "quota_fill_uncapped",
    f"""WITH d AS (SELECT *, {sql_key(f"'{SEED}'", "'action'", 'id')} AS hk FROM ({SPLIT_SQL}))
    SELECT id, split FROM d QUALIFY row_number() OVER (PARTITION BY split ORDER BY hk, id)
      <= {_by_split(TARGETS)}""",
)
def quota_fill_uncapped(spark, folder):
    return sample.quota_fill(
        split_documents(spark, folder), TARGETS, None, SEED, "action"
    ).select("id", "split")


@query(
    "hash_select",
    f"""SELECT id, row_number() OVER (ORDER BY {sql_key(f"'{SEED}'", "'replay-qa-train'", 'id')}, id)
        ::BIGINT AS sample_rank FROM ({B.EVENTS_SQL}) QUALIFY sample_rank <= 1500""",
)
def hash_select(spark, folder):
    return sample.hash_select(B.event_records(spark, folder), 1500, SEED, "replay-qa-train").select(
        "id", F.col("sample_rank").cast("bigint")
    )


@query(
    "prefix_take",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id)::BIGINT AS prefix_rank FROM documents
       QUALIFY prefix_rank <= 333""",
)
def prefix_take(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return sample.prefix_take(docs, "doc_id", 333).select(
        "doc_id", F.col("prefix_rank").cast("bigint")
    )


@query(
    "seeded_shuffle",
    f"SELECT id, {sql_key(f"'{SEED}'", "'shuffle'", 'id')} AS shuffle_key FROM ({B.EVENTS_SQL})",
)
def seeded_shuffle(spark, folder):
    return sample.seeded_shuffle(
        B.event_records(spark, folder).select("id"), SEED, "shuffle"
    )


@query(
    "retain_archived",
    f"""WITH {B.ACTIONS_SQL}, i AS (SELECT DISTINCT 'images/' || p_partkey::VARCHAR || '.jpg' AS image
        FROM part WHERE p_type = 'ECONOMY')
    SELECT id, image FROM a WHERE image IN (SELECT image FROM i) ORDER BY id LIMIT 64""",
)
def retain_archived(spark, folder):
    images = table(spark, folder, "part").where("p_type = 'ECONOMY'").select(
        F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image")
    )
    rows = B.action_predictions(spark, folder).select("id", "image")
    return sample.retain_archived(rows, images, [F.col("id")], 64)


@query(
    "combined_tier",
    f"""WITH {_NESTING}, c AS (SELECT tier, domain, count(*) AS n FROM m GROUP BY ALL)
    SELECT tier, sum(n)::BIGINT AS examples, count(*)::BIGINT AS domains,
      round(max(n) / sum(n)::DOUBLE, 6) AS max_domain_share,
      max(n) / sum(n)::DOUBLE <= 0.055 + 1.0 / sum(n)::DOUBLE AS cap_ok FROM c GROUP BY tier""",
)
def combined_tier(spark, folder):
    return rounded(setops.combined_tier(nesting(spark, folder), SEED, 0.055))
