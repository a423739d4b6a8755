"""Urls, websites, hashes, text and geometry over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, r6, rounded, sql_key, sql_mod, table
from agentcorpus.functions import geometry, hashing, text, web
from agentcorpus.operators import audit, filters, records, website


@query(
    "stable_int",
    f"""SELECT doc_id, (('0x' || {sql_key("'53'", 'doc_id::VARCHAR', 'source')})::UBIGINT)::VARCHAR
        AS stable_int, {sql_mod(100, "'53'", 'doc_id::VARCHAR', 'source')} AS bucket FROM documents""",
)
def stable_int(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    parts = (B.SEED, F.col("doc_id"), F.col("source"))
    return docs.select(
        "doc_id",
        hashing.stable_int(*parts).cast("string").alias("stable_int"),
        hashing.stable_mod(100, *parts).alias("bucket"),
    )


@query(
    "stable_rank",
    "SELECT doc_id, sha256('53:' || doc_id::VARCHAR) AS stable_rank FROM documents",
)
def stable_rank(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.select("doc_id", hashing.stable_rank(B.SEED, F.col("doc_id")).alias("stable_rank"))


@query(
    "canonical_hash",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id::VARCHAR || ',"lang":"' || lang || '","source":"'
       || source || '"}') AS hash FROM documents""",
)
def canonical_hash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return docs.select(
        "doc_id",
        hashing.canonical_hash(
            source=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id")
        ).alias("hash"),
    )


SUFFIXES = (
    ("com", False), ("org", False), ("net", False), ("example.com", False), ("uk", False),
    ("co.uk", False), ("*.ck", False), ("!www.ck", False), ("jp", False), ("*.kobe.jp", False),
    ("!city.kobe.jp", False), ("cn", False), ("\u516c\u53f8.cn", False), ("blogspot.com", True),
)
_SITE_SQL = """CASE WHEN domain = 'example.com' THEN domain
  WHEN suffix(domain, '.example.com') THEN regexp_extract(domain, '([^.]+\\.example\\.com)$', 1)
  WHEN regexp_matches(domain, '\\.(net|org|com)$')
  THEN regexp_extract(domain, '([^.]+\\.(?:net|org|com))$', 1) ELSE domain END"""


@query(
    "registrable_domain",
    f"""WITH r AS (SELECT id, domain, id::BIGINT % 14 AS k FROM ({B.PAGES_SQL}))
    SELECT id, hosts[k + 1] AS hostname, sites[k + 1] AS registrable FROM (SELECT id, k,
      [domain, 'shop.' || domain || '.ck', 'www.ck', 'x' || id || '.www.ck', 'co.ck',
       '10.0.' || (id::BIGINT % 256)::VARCHAR || '.7', '2001:db8::' || id,
       'shop.m\u00fcller.xn--55qx5d.cn', 'a.b' || id || '.\u516c\u53f8.cn', 'co.uk',
       'a.b' || id || '.co.uk', 'u' || id || '.blogspot.com', 'a.city.kobe.jp',
       'a.b' || id || '.c.kobe.jp.'] AS hosts,
      [{_SITE_SQL}, regexp_extract('shop.' || domain || '.ck', '([^.]+\\.[^.]+\\.ck)$', 1), 'www.ck',
       'www.ck', 'co.ck', '10.0.' || (id::BIGINT % 256)::VARCHAR || '.7', '2001:db8::' || id,
       'm\u00fcller.xn--55qx5d.cn', 'b' || id || '.\u516c\u53f8.cn', 'co.uk',
       'b' || id || '.co.uk', 'blogspot.com', 'city.kobe.jp',
       'b' || id || '.c.kobe.jp'] AS sites FROM r)""",
)
def registrable_domain(spark, folder):
    """Hosts of the pages, and made from them ones of wildcard, exception, private and other rules."""
    pages, name = B.page_records(spark, folder).select("id", "domain"), F.col("id")

    def made(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    number = name.cast("bigint")
    hosts = F.array(
        F.col("domain"), made("shop.", F.col("domain"), ".ck"), F.lit("www.ck"),
        made("x", name, ".www.ck"), F.lit("co.ck"),
        made("10.0.", (number % 256).cast("string"), ".7"), made("2001:db8::", name),
        F.lit("shop.m\u00fcller.xn--55qx5d.cn"), made("a.b", name, ".\u516c\u53f8.cn"), F.lit("co.uk"),
        made("a.b", name, ".co.uk"), made("u", name, ".blogspot.com"), F.lit("a.city.kobe.jp"),
        made("a.b", name, ".c.kobe.jp."),
    )
    hosts = pages.select("id", F.get(hosts, (number % 14).cast("int")).alias("hostname"))
    suffixes = spark.createDataFrame(SUFFIXES, "suffix string, private boolean")
    return web.registrable_domain(hosts, suffixes).select("id", "hostname", "registrable")


@query(
    "canonicalize_domain_column",
    f"""WITH r AS ({B.PAGES_SQL}) SELECT id, CASE WHEN task = 'qa' THEN 'known.example'
        ELSE domain END AS domain FROM r""",
)
def canonicalize_domain_column(spark, folder):
    pages = B.page_records(spark, folder)
    recorded = F.when(F.col("task") == "qa", " Known.Example ").when(
        F.col("task") == "grounding", "unknown"
    )
    return records.canonicalize_domain_column(pages.withColumn("domain", recorded)).select(
        "id", "domain"
    )


@query(
    "annotate_website",
    f"""SELECT id, hostname, website_surface, website_category, website_category_confidence,
        website_category_rule, website_category IN ({B.APPLICATIONS_SQL}) AS application_focused
        FROM ({B.ANNOTATED_SQL})""",
)
def annotate_website(spark, folder):
    return records.annotate_website(B.page_records(spark, folder), B.RULES).select(
        "id", "hostname", "website_surface", "website_category", "website_category_confidence",
        "website_category_rule", "application_focused",
    )


_MANY = [(f"*.site{i}.example" if i % 3 else f"campaign={i}x", "content_reference") for i in range(10_000)]
_MANY_SQL = B.ANNOTATED_SQL.replace("'override:0:", "'override:10000:").replace("'override:1:", "'override:10001:")


@query(
    "annotate_website_table",
    f"""SELECT id, hostname, website_category, website_category_confidence, website_category_rule
        FROM ({_MANY_SQL})""",
)
def annotate_website_table(spark, folder):
    """The two rules of the given pages behind ten thousand others."""
    pages = B.page_records(spark, folder)
    return records.annotate_website(pages, [*_MANY, *B.RULES], rule_table=True).select(
        "id", "hostname", "website_category", "website_category_confidence", "website_category_rule"
    )


@query(
    "website_surface",
    f"""WITH r AS ({B.PAGES_SQL}) SELECT website_surface, count(*)::BIGINT AS n FROM (
        SELECT CASE WHEN regexp_extract(url, '/([a-z]{{2}})/', 1) <> ''
          THEN regexp_extract(url, '/([a-z]{{2}})/', 1) || '.google.com' ELSE domain END
          AS website_surface FROM r) GROUP BY website_surface""",
)
def website_surface(spark, folder):
    """Every page moved onto the document host, whose first path part names the product."""
    url = F.regexp_replace("url", "^[a-z]+://[^/]*", "https://docs.google.com")
    pages = B.page_records(spark, folder).withColumn("moved", url)
    return pages.groupBy(web.website_surface(F.col("moved")).alias("website_surface")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "classify_website",
    f"""SELECT website_category, website_category_confidence, website_category_rule,
        count(*)::BIGINT AS n FROM ({B.ANNOTATED_SQL}) GROUP BY ALL""",
)
def classify_website(spark, folder):
    annotated = records.annotate_website(B.page_records(spark, folder), B.RULES)
    return annotated.groupBy(
        "website_category", "website_category_confidence", "website_category_rule"
    ).agg(F.count(F.lit(1)).alias("n"))


def _majority_sql(column: str, out: str) -> str:
    return (
        f"SELECT domain, {column} AS {out}, vals FROM (SELECT domain, {column}, "
        f"count(*) OVER (PARTITION BY domain) AS vals, row_number() OVER (PARTITION BY domain "
        f"ORDER BY n DESC, {column}) AS rn FROM (SELECT domain, {column}, count(*) AS n FROM r "
        f"GROUP BY domain, {column})) WHERE rn = 1"
    )


@query(
    "website_catalog",
    f"""WITH r AS (SELECT *, coalesce('image:' || image, 'record:' || id) AS unit
          FROM ({B.ANNOTATED_SQL})),
    c AS ({_majority_sql('website_category', 'website_category')}),
    f AS ({_majority_sql('website_category_confidence', 'category_confidence')}),
    e AS (SELECT domain, count(*)::BIGINT AS examples, count(DISTINCT unit)::BIGINT AS sampling_units
          FROM r GROUP BY domain)
    SELECT domain, website_category, website_category IN ({B.APPLICATIONS_SQL})
      AS application_focused, category_confidence,
      category_confidence = 'unknown' OR c.vals > 1 AS manual_review_required,
      examples, sampling_units FROM e JOIN c USING (domain) JOIN f USING (domain)""",
)
def website_catalog(spark, folder):
    return website.website_catalog(
        records.annotate_website(B.page_records(spark, folder), B.RULES)
    )


_DIMENSIONS_SQL = f"""
r AS ({B.ANNOTATED_SQL}),
v AS (SELECT domain, 'tasks' AS dimension, task AS value FROM r
  UNION ALL SELECT domain, 'sources', source FROM r
  UNION ALL SELECT domain, 'surfaces', website_surface FROM r
  UNION ALL SELECT domain, 'category_votes', website_category FROM r
  UNION ALL SELECT domain, 'category_confidences', website_category_confidence FROM r
  UNION ALL SELECT domain, 'category_rules', website_category_rule FROM r
  UNION ALL SELECT domain, 'actions', action FROM r WHERE task = 'action'),
d AS (SELECT *, row_number() OVER (PARTITION BY domain, dimension ORDER BY n DESC, value)::INT
        AS position FROM (SELECT domain, dimension, value, count(*)::BIGINT AS n FROM v GROUP BY ALL))
"""


@query(
    "catalog_dimensions",
    f"""WITH {_DIMENSIONS_SQL} SELECT domain, dimension, value, n, position FROM d
        WHERE position <= 20 OR dimension NOT IN ('surfaces', 'category_rules')""",
)
def catalog_dimensions(spark, folder):
    return website.catalog_dimensions(
        records.annotate_website(B.page_records(spark, folder), B.RULES)
    )


@query(
    "dashboard_aggregate",
    f"""WITH r AS ({B.ANNOTATED_SQL}),
    s AS (SELECT domain, website_surface AS surface, count(*)::BIGINT AS n FROM r GROUP BY ALL),
    c AS ({_majority_sql('website_category', 'website_category')})
    SELECT 'task' AS part, task AS key, count(*)::BIGINT AS n FROM r GROUP BY task
    UNION ALL SELECT 'category', website_category, count(*)::BIGINT FROM r GROUP BY website_category
    UNION ALL SELECT 'website', domain, count(*)::BIGINT FROM r GROUP BY domain
    UNION ALL SELECT 'surface', surface, n FROM (SELECT *, row_number() OVER (PARTITION BY domain
      ORDER BY n DESC, surface) AS rn FROM s) WHERE rn <= 8
    UNION ALL SELECT 'category_websites', website_category, count(*)::BIGINT FROM c
      GROUP BY website_category""",
)
def dashboard_aggregate(spark, folder):
    annotated = records.annotate_website(B.page_records(spark, folder), B.RULES)
    parts = website.dashboard_aggregate(annotated)

    def part(name, df, key, n):
        return df.select(F.lit(name).alias("part"), F.col(key).alias("key"), F.col(n).alias("n"))

    return (
        part("task", parts["task_counts"], "task", "n")
        .unionByName(part("category", parts["category_counts"], "category", "n"))
        .unionByName(part("website", parts["websites"], "domain", "examples"))
        .unionByName(part("surface", parts["surfaces"], "surface", "n"))
        .unionByName(part("category_websites", parts["category_websites"], "category", "websites"))
    )


@query(
    "normalize_answer",
    f"""SELECT conv_id, turn, array_to_string({B.tokens_sql('text')}, ' ') AS answer
        FROM conversations""",
)
def normalize_answer(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("answer"))


@query(
    "token_f1",
    f"""WITH d AS (SELECT a.conv_id, a.turn, {B.tokens_sql('a.text')} AS p,
          {B.tokens_sql('b.text')} AS e FROM conversations a JOIN conversations b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    c AS (SELECT conv_id, turn, sum(least(np, ne)) AS common FROM (
        SELECT conv_id, turn, tok, count(*) FILTER (side = 0) AS np,
          count(*) FILTER (side = 1) AS ne
        FROM (SELECT conv_id, turn, unnest(p) AS tok, 0 AS side FROM d
              UNION ALL SELECT conv_id, turn, unnest(e) AS tok, 1 AS side FROM d)
        GROUP BY conv_id, turn, tok) GROUP BY conv_id, turn)
    SELECT conv_id, turn, round(CASE WHEN len(p) + len(e) = 0 THEN 1.0
      ELSE 2.0 * coalesce(common, 0) / (len(p) + len(e)) END::DOUBLE, 6) AS token_f1
    FROM d LEFT JOIN c USING (conv_id, turn)""",
)
def token_f1(spark, folder):
    """Each turn against the one after it."""
    turns = table(spark, folder, "conversations")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text")
    )
    pairs = turns.join(following, ["conv_id", "turn"])
    return pairs.select(
        "conv_id", "turn", r6(text.token_f1(F.col("text"), F.col("next_text"))).alias("token_f1")
    )


@query(
    "first_answer",
    f"""WITH q AS ({B.QA_SQL}) SELECT id, label,
        trim(regexp_replace(prediction, '(?s)\\n(user|assistant)\\n.*$', ''), chr(32) || chr(10))
        AS shown FROM q""",
)
def first_answer(spark, folder):
    rows = B.qa_predictions(spark, folder)
    return rows.select("id", "label", text.first_answer(F.col("prediction")).alias("shown"))


_EMB = {
    "x1": "(embedding[1]::DOUBLE + 0.5) * 1000",
    "y1": "(embedding[2]::DOUBLE + 0.5) * 600",
    "x2": "(embedding[3]::DOUBLE + 0.5) * 1000",
    "y2": "(embedding[4]::DOUBLE + 0.5) * 600",
}


def _clamp_sql(value: str) -> str:
    return f"greatest(0.0, least(1000.0, {value}))"


@query(
    "box_geometry",
    f"""WITH b AS (SELECT vec_id, {', '.join(f'{v} AS {k}' for k, v in _EMB.items())},
          (embedding[5]::DOUBLE + 0.5) * 1000 AS px, (embedding[6]::DOUBLE + 0.5) * 1000 AS py
          FROM embeddings),
    n AS (SELECT vec_id, px, py, {_clamp_sql('x1 / 1000 * 1000.0')} AS gx1,
          {_clamp_sql('y1 / 600 * 1000.0')} AS gy1, {_clamp_sql('x2 / 1000 * 1000.0')} AS gx2,
          {_clamp_sql('y2 / 600 * 1000.0')} AS gy2 FROM b)
    SELECT vec_id, round(gx1, 6) AS gx1, round(gy1, 6) AS gy1, round(gx2, 6) AS gx2,
      round(gy2, 6) AS gy2, round((gx1 + gx2) / 2, 6) AS cx, round((gy1 + gy2) / 2, 6) AS cy,
      px BETWEEN least(gx1, gx2) AND greatest(gx1, gx2)
        AND py BETWEEN least(gy1, gy2) AND greatest(gy1, gy2) AS inside,
      round(sqrt(pow((px - (gx1 + gx2) / 2) / 1000 * 1000, 2)
        + pow((py - (gy1 + gy2) / 2) / 1000 * 600, 2)), 6) AS distance,
      round(gx1 / 1000 * 1000, 6) AS bx1, round(px / 1000 * 1000, 6) AS ppx FROM n""",
)
def box_geometry(spark, folder):
    """Normalised boxes, centres, hits and pixel distances of points taken from the vectors."""
    vectors = table(spark, folder, "embeddings")

    def at(i, scale):
        return (F.col("embedding")[i].cast("double") + 0.5) * scale

    width, height = F.lit(1000), F.lit(600)
    raw = F.array(at(0, 1000), at(1, 600), at(2, 1000), at(3, 600))
    boxed = vectors.select(
        "vec_id",
        geometry.normalize_bbox(raw, width, height).alias("box"),
        F.array(at(4, 1000), at(5, 1000)).alias("point"),
    )
    box, point = F.col("box"), F.col("point")
    center = geometry.bbox_center(box)
    return boxed.select(
        "vec_id",
        r6(box[0]).alias("gx1"), r6(box[1]).alias("gy1"),
        r6(box[2]).alias("gx2"), r6(box[3]).alias("gy2"),
        r6(center[0]).alias("cx"), r6(center[1]).alias("cy"),
        geometry.point_in_bbox(point, box).alias("inside"),
        r6(geometry.pixel_distance(point, center, width, height)).alias("distance"),
        r6(geometry.bbox_to_pixels(box, width, height)[0]).alias("bx1"),
        r6(geometry.point_to_pixels(point, width, height)[0]).alias("ppx"),
    )


_SCALE_SQL = "least(1280::DOUBLE / w, 720::DOUBLE / h, 1::DOUBLE)"


@query(
    "target_dimensions",
    f"""WITH d AS (SELECT p_partkey, (p_size * 61)::INT AS w, floor(p_retailprice)::INT AS h FROM part)
    SELECT p_partkey, CASE WHEN {_SCALE_SQL} >= 1 THEN w
      ELSE greatest(1.0, round_even(w * {_SCALE_SQL}, 0)) END::INT AS width,
      CASE WHEN {_SCALE_SQL} >= 1 THEN h
      ELSE greatest(1.0, round_even(h * {_SCALE_SQL}, 0)) END::INT AS height FROM d""",
)
def target_dimensions(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") * 61).cast("int").alias("w"),
        F.floor("p_retailprice").cast("int").alias("h"),
    )
    return parts.select(
        "p_partkey", geometry.target_dimensions(F.col("w"), F.col("h"), 1280, 720).alias("d")
    ).select("p_partkey", "d.width", "d.height")


@query(
    "image_path_violations",
    """SELECT DISTINCT image FROM (SELECT CASE WHEN n_chars % 4 = 0 THEN 'images/../' || source
         WHEN n_chars % 4 = 1 THEN '//images/' || lang WHEN n_chars % 4 = 2 THEN 'tmp/' || source
         ELSE '/images/' || source END AS raw, regexp_replace(raw, '^/', '') AS image FROM documents)
       WHERE contains(image, '/../') OR prefix(image, '/') OR NOT prefix(image, 'images/')""",
)
def image_path_violations(spark, folder):
    docs = table(spark, folder, "documents")
    n = F.col("n_chars") % 4
    raw = (
        F.when(n == 0, F.concat(F.lit("images/../"), "source"))
        .when(n == 1, F.concat(F.lit("//images/"), "lang"))
        .when(n == 2, F.concat(F.lit("tmp/"), "source"))
        .otherwise(F.concat(F.lit("/images/"), "source"))
    )
    return filters.image_path_violations(docs.select(raw.alias("image")))


@query(
    "facet_search",
    """SELECT doc_id, source, lang FROM documents
       WHERE contains(lower(text || ' ' || source), 'the') AND lang = 'en'""",
)
def facet_search(spark, folder):
    docs = table(spark, folder, "documents")
    return filters.facet_search(docs, " The ", ["text", "source"], {"lang": "en", "source": "all"}).select(
        "doc_id", "source", "lang"
    )


@query(
    "exclude_domains",
    f"""WITH r AS ({B.DOCUMENTS_SQL})
    SELECT 'kept' AS part, domain, count(*)::BIGINT AS n FROM r
      WHERE domain NOT IN ('src1', 'src7') GROUP BY domain
    UNION ALL SELECT 'dropped', domain, count(*)::BIGINT FROM r
      WHERE domain IN ('src1', 'src7') GROUP BY domain""",
)
def exclude_domains(spark, folder):
    kept, dropped = filters.exclude_domains(B.document_records(spark, folder), ["SRC1", "src7"])
    counts = kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit("kept").alias("part"), "domain", "n").unionByName(
        dropped.select(F.lit("dropped").alias("part"), "domain", "n")
    )


@query(
    "exclude_sources",
    "SELECT source, count(*)::BIGINT AS n FROM documents WHERE source IN ('src3') GROUP BY source",
)
def exclude_sources(spark, folder):
    return filters.contaminated(table(spark, folder, "documents"), ["src3"])


@query(
    "reject_unknown_domains",
    f"SELECT id, task FROM ({B.DOCUMENTS_SQL}) WHERE domain = 'unknown'",
)
def reject_unknown_domains(spark, folder):
    return filters.unknown_domains(B.document_records(spark, folder)).select("id", "task")


@query(
    "source_label_check",
    f"""SELECT source AS manifest_source, domain AS source, count(*)::BIGINT AS n
        FROM ({B.DOCUMENTS_SQL}) WHERE source <> domain GROUP BY ALL""",
)
def source_label_check(spark, folder):
    rows = B.document_records(spark, folder).select(
        F.col("source").alias("manifest_source"), F.col("domain").alias("source")
    )
    return filters.source_label_check(rows)


AUDIT_SQL = """
d AS (SELECT domain, count(*) AS n FROM r GROUP BY domain)
SELECT (SELECT count(*) FROM r)::BIGINT AS examples, (SELECT count(*) FROM d)::BIGINT
    AS unique_domains, (SELECT count(DISTINCT unit) FROM r)::BIGINT AS unique_sampling_units,
  (SELECT count(DISTINCT trajectory_id) FROM r)::BIGINT AS unique_trajectories,
  (SELECT count(DISTINCT image) FROM r)::BIGINT AS unique_images,
  round((SELECT max(n) FROM d) / (SELECT count(*) FROM r)::DOUBLE, 6) AS max_domain_share,
  round((SELECT sum(n) FROM (SELECT n FROM d ORDER BY n DESC, domain LIMIT 5))
    / (SELECT count(*) FROM r)::DOUBLE, 6) AS top_5_domain_share,
  round((SELECT count(*) FROM r)::DOUBLE * (SELECT count(*) FROM r)
    / (SELECT sum(n * n) FROM d), 6) AS effective_domains,
  round((SELECT avg(application_focused::INT::DOUBLE) FROM r), 6) AS application_focused_share
"""


@query("audit", f"WITH r AS (SELECT *, NULL AS trajectory_id FROM ({B.DOCUMENTS_SQL})), {AUDIT_SQL}")
def audit_documents(spark, folder):
    return rounded(audit.audit(B.document_records(spark, folder)))


@query(
    "audit_pages",
    f"""WITH r AS (SELECT *, NULL AS trajectory_id, coalesce('image:' || image, 'record:' || id)
        AS unit, website_category IN ({B.APPLICATIONS_SQL}) AS application_focused
        FROM ({B.ANNOTATED_SQL})), {AUDIT_SQL}""",
)
def audit_pages(spark, folder):
    """Pages to hosts to categories to one audit row: the flagship chain."""
    annotated = records.annotate_website(B.page_records(spark, folder), B.RULES)
    return rounded(audit.audit(annotated))


@query(
    "audit_distributions",
    f"""WITH r AS ({B.DOCUMENTS_SQL}) SELECT kind, value, count(*)::BIGINT AS n FROM (
      SELECT 'domain' AS kind, domain AS value FROM r UNION ALL SELECT 'task', task FROM r
      UNION ALL SELECT 'source', source FROM r
      UNION ALL SELECT 'website_category', website_category FROM r
      UNION ALL SELECT 'action', action FROM r WHERE task = 'action'
      UNION ALL SELECT 'question_type', question_type FROM r WHERE task = 'qa') GROUP BY ALL""",
)
def audit_distributions(spark, folder):
    return audit.audit_distributions(B.document_records(spark, folder))


@query(
    "value_distribution",
    """SELECT coalesce(nullif(lang, ''), 'unknown') AS value, count(*)::BIGINT AS n FROM documents
       GROUP BY ALL""",
)
def value_distribution(spark, folder):
    return audit.value_distribution(table(spark, folder, "documents"), "lang")


_LABELLED = "SELECT d.source, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)"


@query(
    "macro_metric",
    f"""WITH j AS ({_LABELLED}), g AS (SELECT source, count(quality) AS n, sum(quality) AS s
      FROM j WHERE quality IS NOT NULL GROUP BY source)
    SELECT sum(n)::BIGINT AS examples, count(*)::BIGINT AS groups,
      round(sum(s)::DOUBLE / sum(n), 6) AS micro, round(avg(s::DOUBLE / n), 6) AS macro FROM g""",
)
def macro_metric(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return rounded(audit.macro_metric(joined, "quality", "source"))


@query(
    "group_means",
    f"""WITH j AS ({_LABELLED}) SELECT lang, source AS "group", count(toxic)::BIGINT AS examples,
      round(avg(toxic::DOUBLE), 6) AS mean FROM j WHERE toxic IS NOT NULL GROUP BY ALL""",
)
def group_means(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return rounded(audit.group_means(joined, "toxic", "source", ["lang"])).drop("total")


@query(
    "action_counts",
    f"""SELECT action, count(*)::BIGINT AS n FROM ({B.DOCUMENTS_SQL}) WHERE task = 'action'
        GROUP BY action""",
)
def action_counts(spark, folder):
    return audit.action_counts(B.document_records(spark, folder).where("task = 'action'"))


@query(
    "display_projection",
    f"""SELECT id, task, domain, website_surface AS surface, website_category AS category,
        website_category_confidence AS category_confidence, source, url,
        image, image IS NOT NULL AS image_available FROM ({B.ANNOTATED_SQL})""",
)
def display_projection(spark, folder):
    annotated = records.annotate_website(B.page_records(spark, folder), B.RULES)
    return records.display_projection(annotated, "image").select(
        "id", "task", "domain", "surface", "category", "category_confidence", "source", "url",
        "image", "image_available",
    )
