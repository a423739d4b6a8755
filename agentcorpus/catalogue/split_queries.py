"""Split, partition, destination and shard assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, sql_mod, table
from agentcorpus.operators import audit, records, split

SPLITS = {"train": 80, "validation": 10, "test": 10}


def _split_sql(key: str) -> str:
    bucket = sql_mod(100, f"'{B.SEED}'", key)
    return (
        f"CASE WHEN {bucket} < 80 THEN 'train' WHEN {bucket} < 90 THEN 'validation' "
        "ELSE 'test' END"
    )


SPLIT_SQL = f"""
SELECT *, CASE WHEN domain <> 'unknown' THEN domain ELSE id END AS split_key,
  {_split_sql("CASE WHEN domain <> 'unknown' THEN domain ELSE id END")} AS split
FROM ({B.DOCUMENTS_SQL})
"""


def split_documents(spark, folder):
    rows = B.document_records(spark, folder)
    key = split.split_key(F.col("domain"), F.col("id"))
    return rows.withColumn("split_key", key).withColumn(
        "split", split.domain_split(F.col("split_key"), B.SEED, SPLITS)
    )


@query("domain_split", f"SELECT id, split_key, split FROM ({SPLIT_SQL})")
def domain_split(spark, folder):
    return split_documents(spark, folder).select("id", "split_key", "split")


@query(
    "domain_bucket",
    f"""SELECT id, domain, {sql_mod(100, f"'{B.SEED}'", 'domain')} AS bucket
        FROM ({B.PAGES_SQL})""",
)
def domain_bucket(spark, folder):
    from agentcorpus.functions.hashing import stable_mod

    return B.page_records(spark, folder).select(
        "id", "domain", stable_mod(100, B.SEED, F.col("domain")).alias("bucket")
    )


@query(
    "domain_partition",
    f"SELECT id, domain, {B.partition_sql('domain')} AS part FROM ({B.PAGES_SQL})",
)
def domain_partition(spark, folder):
    return B.page_records(spark, folder).select(
        "id", "domain", split.domain_partition(F.col("domain"), B.SEED, B.SHARES).alias("part")
    )


@query(
    "sampling_unit",
    f"""SELECT id, coalesce('image:' || image, 'record:' || id) AS unit FROM ({B.PAGES_SQL})
        UNION ALL SELECT id, unit FROM ({B.EVENTS_SQL})""",
)
def sampling_unit(spark, folder):
    pages = records.with_unit(B.page_records(spark, folder)).select("id", "unit")
    events = B.event_records(spark, folder).drop("unit")
    return pages.unionByName(records.with_unit(events).select("id", "unit"))


@query(
    "unit_domains_join",
    f"""WITH r AS ({B.EVENTS_SQL}), u AS (SELECT unit, count(DISTINCT domain)::BIGINT AS
        unit_domains, max(domain = 'unknown') AS has_unknown FROM r GROUP BY unit)
        SELECT id, unit, unit_domains, has_unknown FROM r JOIN u USING (unit)""",
)
def unit_domains_join(spark, folder):
    rows = B.event_records(spark, folder)
    state = split.unit_state(rows, B.SEED, B.SHARES).select("unit", "unit_domains", "has_unknown")
    return rows.join(state, "unit").select("id", "unit", "unit_domains", "has_unknown")


def assigned_events(spark, folder):
    return split.assign_destination(
        B.event_records(spark, folder), B.SEED, B.SHARES, B.IID_PERCENT
    )


@query(
    "assign_destination",
    f"WITH {B.DESTINATIONS_SQL} SELECT id, unit, destination, cross_partition FROM a",
)
def assign_destination(spark, folder):
    return assigned_events(spark, folder).select("id", "unit", "destination", "cross_partition")


@query(
    "unit_split_audit",
    f"""WITH {B.DESTINATIONS_SQL} SELECT (SELECT count(*) FROM u)::BIGINT AS units,
        (SELECT count(*) FROM u WHERE unit_domains > 1)::BIGINT AS cross_domain_units,
        (SELECT count(*) FROM u WHERE has_unknown OR parts > 1)::BIGINT
          AS excluded_cross_partition_units,
        (SELECT count(DISTINCT unit) FROM a WHERE destination IS NOT NULL)::BIGINT
          AS assigned_units""",
)
def unit_split_audit(spark, folder):
    return split.unit_split_audit(
        B.event_records(spark, folder), B.SEED, B.SHARES, B.IID_PERCENT
    )


@query(
    "excluded_records_by_task",
    f"""WITH {B.DESTINATIONS_SQL} SELECT task, count(*)::BIGINT AS records FROM a
        WHERE destination IS NULL AND cross_partition GROUP BY task""",
)
def excluded_records_by_task(spark, folder):
    return split.excluded_records_by_task(assigned_events(spark, folder))


@query(
    "single_destination_check",
    f"""WITH r AS ({SPLIT_SQL})
    SELECT 'unit' AS kind, unit AS key, min(split) AS low, max(split) AS high FROM r
      GROUP BY unit HAVING min(split) <> max(split)
    UNION ALL SELECT 'domain', domain, min(split), max(split) FROM r
      GROUP BY domain HAVING min(split) <> max(split)""",
)
def single_destination_check(spark, folder):
    """A careless split by domain alone: copies of a text and unknown domains end up on both sides."""
    rows = records.with_unit(split_documents(spark, folder)).withColumn(
        "destination", F.col("split")
    )
    return split.destination_conflicts(rows)


@query(
    "destination_conflicts",
    f"""WITH {B.DESTINATIONS_SQL} SELECT 'unit' AS kind, unit AS key, min(destination) AS low,
        max(destination) AS high FROM a WHERE destination IS NOT NULL GROUP BY unit
        HAVING min(destination) <> max(destination)""",
)
def destination_conflicts(spark, folder):
    """The real assignment has none."""
    return split.destination_conflicts(assigned_events(spark, folder))


@query(
    "shard_by_position",
    """SELECT doc_id, lang, p AS position, (p % 7)::INT AS shard FROM (
         SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p
         FROM documents)""",
)
def shard_by_position(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return split.shard_by_position(docs, "lang", "doc_id", 7)


@query(
    "shard_by_position_limit",
    """SELECT doc_id, lang, p AS position FROM (
         SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p
         FROM documents) WHERE p % 4 = 2 AND p // 4 < 20""",
)
def shard_by_position_limit(spark, folder):
    """One shard of four, first twenty rows of each manifest."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return split.shard_by_position(docs, "lang", "doc_id", 4, 2, 20).drop("shard")


_CHUNKS = [f"('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT" for i in range(8)]


def _fold(modulus: int) -> str:
    shift = (1 << 32) % modulus
    text = "0"
    for chunk in _CHUNKS:
        text = f"(({text}) * {shift} + {chunk}) % {modulus}"
    return text


@query(
    "shard_by_hash",
    f"""SELECT page_id, ({_fold(13)})::INT AS shard
        FROM (SELECT page_id, sha256(url) AS h FROM pages)""",
)
def shard_by_hash(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", split.shard_by_hash(F.col("url"), 13).alias("shard"))


@query(
    "proportional_targets",
    """WITH c AS (SELECT source, count(*) AS train, min(doc_id) AS ord FROM documents GROUP BY source),
    t AS (SELECT unnest([['validation', '137'], ['test', '71']]) AS p),
    e AS (SELECT source, p[1] AS split, p[2]::BIGINT AS total, ord,
      p[2]::BIGINT * train / (SELECT sum(train) FROM c)::DOUBLE AS exact FROM c, t),
    f AS (SELECT *, floor(exact) AS base, row_number() OVER (PARTITION BY split
      ORDER BY exact - floor(exact) DESC, ord) AS rn, sum(floor(exact)) OVER (PARTITION BY split)
      AS given FROM e)
    SELECT source, split, (base + CASE WHEN rn <= total - given THEN 1 ELSE 0 END)::BIGINT AS target
    FROM f""",
)
def proportional_targets(spark, folder):
    docs = table(spark, folder, "documents")
    counts = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("train"), F.min("doc_id").alias("ord")
    )
    return split.proportional_targets(counts, {"validation": 137, "test": 71})


@query(
    "trajectory_isolation",
    """SELECT conv_id::VARCHAR AS trajectory_id, min(role) AS first_split, max(role) AS last_split,
       count(DISTINCT role)::BIGINT AS splits FROM conversations GROUP BY conv_id
       HAVING count(DISTINCT role) > 1""",
)
def trajectory_isolation(spark, folder):
    """Roles taken as splits, so that every mixed conversation is a violation."""
    steps = B.conversation_steps(spark, folder).withColumnRenamed("action", "split")
    return split.trajectory_isolation(steps)


@query(
    "domain_isolation",
    f"""WITH d AS (SELECT DISTINCT split, domain FROM ({SPLIT_SQL}))
    SELECT l.split AS left_split, r.split AS right_split, domain FROM d l JOIN d r USING (domain)
    WHERE (l.split = 'train' AND r.split IN ('validation', 'test'))
       OR (l.split = 'validation' AND r.split = 'test')""",
)
def domain_isolation(spark, folder):
    return split.domain_isolation(
        split_documents(spark, folder), ("train", "validation", "test")
    )


@query(
    "split_summary",
    f"""SELECT split, count(*)::BIGINT AS examples, count(DISTINCT domain)::BIGINT AS domains
        FROM ({SPLIT_SQL}) GROUP BY split""",
)
def split_summary(spark, folder):
    return audit.split_summary(split_documents(spark, folder))


@query(
    "source_counts",
    f"SELECT source, split, count(*)::BIGINT AS n FROM ({SPLIT_SQL}) GROUP BY ALL",
)
def source_counts(spark, folder):
    return audit.source_counts(split_documents(spark, folder))


@query(
    "source_counts_design",
    f"""WITH e AS (SELECT CASE task WHEN 'qa' THEN 'train' WHEN 'grounding' THEN 'validation'
          ELSE 'test' END AS split, count(*)::BIGINT AS expected FROM ({B.DOCUMENTS_SQL}) GROUP BY ALL),
    c AS (SELECT split, count(*)::BIGINT AS n FROM ({SPLIT_SQL}) GROUP BY split)
    SELECT split, coalesce(n, 0)::BIGINT AS n, expected, n IS NOT DISTINCT FROM expected AS matches
    FROM e FULL JOIN c USING (split)""",
)
def source_counts_design(spark, folder):
    rows = B.document_records(spark, folder)
    name = F.when(F.col("task") == "qa", "train").when(
        F.col("task") == "grounding", "validation"
    ).otherwise("test")
    expected = rows.groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("expected"))
    return audit.source_counts(split_documents(spark, folder), expected)
