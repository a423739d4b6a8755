"""Whole preparation runs: candidates to frozen pools and suites, and these to training tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, sql_mod, table
from agentcorpus.plans import inventory, ladder

SUITES = {"iid": {"qa": 15, "grounding": 5}, "domain_balanced": {"grounding": 8}}
SIZES = {"small": 30, "large": 80}
SPEC = inventory.InventorySpec(
    seed=B.SEED,
    partitions=B.SHARES,
    iid_percent=B.IID_PERCENT,
    evaluation_targets=SUITES,
    evaluation_sampling={"natural_suites": list(SUITES)},
    excluded_domains=["site3.example"],
)
_SITES = 40
_CANDIDATES_SQL = f"""
r AS (SELECT event_id::VARCHAR AS id, 'site' || (event_id % {_SITES})::VARCHAR || '.example' AS domain,
  CASE WHEN value < 5 THEN 'qa' WHEN value < 12 THEN 'grounding' ELSE 'action' END AS task,
  CASE WHEN event_type = 'error' THEN 'distribution_shift' ELSE 'training' END AS source_role,
  'record:' || event_id::VARCHAR AS unit FROM events WHERE event_id % {_SITES} <> 3),
p AS (SELECT *, {B.partition_sql('domain')} AS part FROM r),
a AS (SELECT *, CASE WHEN source_role = 'distribution_shift'
    THEN CASE WHEN part = 'distribution_shift' THEN part END
    WHEN part = 'domain_balanced' THEN part
    WHEN part = 'train' THEN CASE WHEN {sql_mod(100, "'exp005-iid'", f"'{B.SEED}'", 'unit')}
      < {B.IID_PERCENT} THEN 'iid' ELSE 'train' END END AS destination FROM p)
"""


def candidates(spark, folder) -> DataFrame:
    """Events as records of forty sites, each a unit of its own."""
    events, value = table(spark, folder, "events"), F.col("value")
    site = F.concat(F.lit("site"), (F.col("event_id") % _SITES).cast("string"), F.lit(".example"))
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        site.alias("domain"),
        F.concat(F.lit("https://"), site, F.lit("/"), F.col("event_id").cast("string")).alias("url"),
        F.col("event_type").alias("source"),
        F.when(value < 5, "qa").when(value < 12, "grounding").otherwise("action").alias("task"),
        F.when(F.col("event_type") == "error", "distribution_shift").otherwise("training").alias(
            "source_role"
        ),
    )


def _counts(part: str, df: DataFrame, name) -> DataFrame:
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(part).alias("part"), "name", "n"
    )


@query(
    "inventory_freeze",
    f"""WITH {_CANDIDATES_SQL}
    SELECT 'destination' AS part, coalesce(destination, 'none') AS name, count(*)::BIGINT AS n
      FROM a GROUP BY ALL
    UNION ALL SELECT 'excluded', 'records', count(*)::BIGINT FROM events WHERE event_id % {_SITES} = 3
    UNION ALL SELECT 'pool', task, count(*)::BIGINT FROM a WHERE destination = 'train' GROUP BY task
    UNION ALL SELECT 'catalog', 'domains', count(DISTINCT domain)::BIGINT FROM r
    UNION ALL SELECT 'catalog', 'examples', count(*)::BIGINT FROM r
    UNION ALL SELECT 'units', 'assigned', count(*)::BIGINT FROM a WHERE destination IS NOT NULL
    UNION ALL SELECT * FROM (VALUES ('suite', 'iid/qa', 15::BIGINT), ('suite', 'iid/grounding', 5::BIGINT),
      ('suite', 'domain_balanced/grounding', 8::BIGINT)) v(part, name, n)""",
)
def inventory_freeze(spark, folder):
    """Sizes of everything that one freeze returns."""
    frozen = inventory.freeze(candidates(spark, folder), SPEC)
    catalog, units = frozen["catalog"], frozen["unit_audit"]
    parts = [
        _counts("destination", frozen["assigned"], F.coalesce("destination", F.lit("none"))),
        frozen["excluded_domains"].agg(
            F.lit("excluded").alias("part"), F.lit("records").alias("name"), F.sum("n").alias("n")
        ),
        *[_counts("pool", frozen[f"train_{task}"], F.col("task")) for task in ("qa", "grounding", "action")],
        _counts("catalog", catalog, F.lit("domains")),
        catalog.agg(F.lit("catalog").alias("part"), F.lit("examples").alias("name"), F.sum("examples").alias("n")),
        units.select(
            F.lit("units").alias("part"), F.lit("assigned").alias("name"), F.col("assigned_units").alias("n")
        ),
        *[
            _counts("suite", frozen[f"suite_{suite}"], F.concat(F.lit(f"{suite}/"), F.col("task")))
            for suite in SUITES
        ],
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "training_ladder",
    f"""WITH {_CANDIDATES_SQL},
    t AS (SELECT * FROM (VALUES ('qa'), ('grounding')) x(task)),
    s AS (SELECT * FROM (VALUES ('small', 30), ('large', 80)) y(tier, size))
    SELECT 'tier' AS part, task || '/' || tier AS name, size::BIGINT AS n, true AS holds FROM t, s
    UNION ALL SELECT 'combined', tier, (2 * size)::BIGINT, true FROM s
    UNION ALL SELECT 'leakage', 'training', count(*)::BIGINT, true FROM a WHERE destination = 'train'
    UNION ALL SELECT 'leakage', 'evaluation', 28::BIGINT, true
    UNION ALL SELECT 'leakage', 'shared', 0::BIGINT, true""",
)
def training_ladder(spark, folder):
    """Freeze, then leakage gates and nested tiers over its pools: sizes, and whether limits hold."""
    frozen = inventory.freeze(candidates(spark, folder), SPEC)
    training = frozen["assigned"].where(F.col("destination") == "train")
    suites = reduce(
        DataFrame.unionByName,
        [frozen[f"suite_{suite}"].withColumn("suite", F.lit(suite)) for suite in SUITES],
    )
    task = ladder.TaskSpec(sizes=SIZES, max_domain_share=0.1)
    built = ladder.build_ladder(
        training, suites, {"qa": task, "grounding": task}, B.SEED,
        {"domain_balanced": ["id", "sampling_unit", "known_domain"], "iid": ["id", "sampling_unit"]},
    )
    leakage = built["leakage"]
    shared = F.col("id_overlap_count") + F.col("sampling_unit_overlap_count")
    rows = [
        built["tier_audit"].select(
            F.lit("tier").alias("part"), F.concat_ws("/", "task", "tier").alias("name"),
            F.col("examples").alias("n"), (F.col("cap_ok") & F.col("floor_ok")).alias("holds"),
        ),
        built["combined_audit"].select(
            F.lit("combined").alias("part"), F.col("tier").alias("name"),
            F.col("examples").alias("n"), F.col("cap_ok").alias("holds"),
        ),
        *[
            leakage.select(
                F.lit("leakage").alias("part"), F.lit(name).alias("name"), n.alias("n"), F.lit(True).alias("holds")
            )
            for name, n in (
                ("training", F.col("training_examples")), ("evaluation", F.col("evaluation_examples")),
                ("shared", shared),
            )
        ],
    ]
    return reduce(DataFrame.unionByName, rows)
