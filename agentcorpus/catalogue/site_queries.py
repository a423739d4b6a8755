"""Operators over registrable domains: hosts with subdomains count as one site."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, rounded
from agentcorpus.catalogue.expansion_queries import (
    KEEP, LINES_SQL, PAST, SOURCE, _messages_sql, raw_screenshots, raw_trajectories,
)
from agentcorpus.catalogue.scalar_queries import AUDIT_SQL
from agentcorpus.operators import audit, expand, records, split

SUFFIXES = ("com", "org", "net")
RULES = (*SUFFIXES, "*.ck", "!www.ck")


def suffixes(spark):
    return spark.createDataFrame([(s,) for s in RULES], "suffix string")


def site_sql(domain: str) -> str:
    listed = "|".join(SUFFIXES)
    return f"""CASE WHEN suffix({domain}, '.www.ck') THEN 'www.ck'
      WHEN suffix({domain}, '.ck') THEN regexp_extract({domain}, '([^.]+[.][^.]+[.]ck)$', 1)
      ELSE coalesce(nullif(regexp_extract({domain}, '([^.]+[.](?:{listed}))$', 1), ''), {domain}) END"""


HOSTS_SQL = """CASE id::BIGINT % 5 WHEN 1 THEN domain || '.ck' WHEN 2 THEN domain || '.www.ck'
  WHEN 3 THEN '10.1.2.' || (id::BIGINT % 200)::VARCHAR ELSE domain END"""


def site_pages(spark, folder):
    """Pages of which some lie beneath a wildcard rule, an exception or an address."""
    pages, number = B.page_records(spark, folder), F.col("id").cast("bigint")
    address = F.concat(F.lit("10.1.2."), (number % 200).cast("string"))
    hosts = (
        F.when(number % 5 == 1, F.concat("domain", F.lit(".ck")))
        .when(number % 5 == 2, F.concat("domain", F.lit(".www.ck")))
        .when(number % 5 == 3, address)
        .otherwise(F.col("domain"))
    )
    pages = records.canonicalize_domain_column(pages.withColumn("domain", hosts), suffixes(spark))
    return pages.withColumn(
        "source_role", F.when(F.col("task") == "qa", "distribution_shift").otherwise("training")
    )


SITES_SQL = f"""
SELECT * REPLACE ({site_sql('domain')} AS domain),
  coalesce('image:' || image, 'record:' || id) AS unit,
  CASE WHEN task = 'qa' THEN 'distribution_shift' ELSE 'training' END AS source_role
FROM (SELECT * REPLACE ({HOSTS_SQL} AS domain) FROM ({B.PAGES_SQL}))
"""


@query(
    "site_trajectories",
    f"""WITH {LINES_SQL} SELECT substr(sha256(concat_ws(chr(31), 'docs', sample_id, i::VARCHAR)), 1, 24)
      AS id, {site_sql("CASE i % 3 WHEN 0 THEN source || '.example.com' ELSE 'direct.example.org' END")}
      AS domain, coalesce(len(blocks), 0)::INT AS history_steps FROM h WHERE rk <= {KEEP}""",
)
def site_trajectories(spark, folder):
    examples = expand.explode_trajectory(
        raw_trajectories(spark, folder), SOURCE, PAST, KEEP, suffixes=suffixes(spark)
    )
    return examples.select("id", "domain", "history_steps")


@query(
    "site_messages",
    f"""WITH {_messages_sql('qa', 'n % 4 <> 0')} SELECT id, {site_sql("source || '.example.com'")}
        AS domain, question FROM k""",
)
def site_messages(spark, folder):
    rows = expand.explode_messages(
        raw_screenshots(spark, folder), {"id": "qa-source", "task": "qa"}, 3,
        F.lit("documents"), F.col("doc_id"), suffixes=suffixes(spark),
    )
    return rows.select("id", "domain", "question")


@query(
    "site_partition",
    f"SELECT id, domain, {B.partition_sql('domain')} AS part FROM ({SITES_SQL})",
)
def site_partition(spark, folder):
    return site_pages(spark, folder).select(
        "id", "domain", split.domain_partition(F.col("domain"), B.SEED, B.SHARES).alias("part")
    )


@query(
    "site_destinations",
    f"WITH {B.DESTINATIONS_SQL.replace(B.EVENTS_SQL, SITES_SQL)} "
    "SELECT id, unit, destination, cross_partition FROM a",
)
def site_destinations(spark, folder):
    assigned = split.assign_destination(
        records.with_unit(site_pages(spark, folder)), B.SEED, B.SHARES, B.IID_PERCENT
    )
    return assigned.select("id", "unit", "destination", "cross_partition")


@query(
    "site_audit",
    f"""WITH r AS (SELECT *, NULL AS trajectory_id, 'general_web' AS website_category,
        false AS application_focused FROM ({SITES_SQL})), {AUDIT_SQL}""",
)
def site_audit(spark, folder):
    pages = site_pages(spark, folder).withColumns(
        {"website_category": F.lit("general_web"), "application_focused": F.lit(False)}
    )
    return rounded(audit.audit(pages))
