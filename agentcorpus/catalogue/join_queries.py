"""Alignment, coverage, materialisation and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, scratch, sql_key, sql_mod, table
from agentcorpus.catalogue.split_queries import SPLIT_SQL, split_documents
from agentcorpus.functions import hashing
from agentcorpus.operators import align, audit, records, setops


@query(
    "align_predictions",
    f"""WITH q AS ({B.QA_SQL}) SELECT id, max(CASE WHEN label = 'baseline' THEN prediction END) AS
        baseline, max(CASE WHEN label = 'latest' THEN prediction END) AS latest FROM q GROUP BY id""",
)
def align_predictions(spark, folder):
    return align.align_predictions(B.qa_predictions(spark, folder), B.LABELS)


@query(
    "alignment_issues",
    """SELECT doc_id AS id, label, n FROM (SELECT doc_id, unnest(['quality', 'text']) AS label,
         unnest([q, t]) AS n FROM (SELECT doc_id, count(*) FILTER (label = 'quality') AS q,
           count(*) FILTER (label = 'text') AS t FROM (
             SELECT doc_id, 'quality' AS label FROM labels UNION ALL
             SELECT doc_id, 'text' FROM documents) GROUP BY doc_id)) WHERE n <> 1""",
)
def alignment_issues(spark, folder):
    """Documents without a quality label, as ids that one set lacks."""
    rows = (
        table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.lit("quality").alias("label"))
        .unionByName(
            table(spark, folder, "documents").select(
                F.col("doc_id").alias("id"), F.lit("text").alias("label")
            )
        )
    )
    return align.alignment_issues(rows, ("quality", "text"))


@query(
    "restrict_to_reference",
    "SELECT doc_id AS id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def restrict_to_reference(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    reference = table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return align.restrict_to_reference(docs, reference)


@query(
    "resume_pending",
    "SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def resume_pending(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    done = table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return align.resume_pending(docs, done)


@query(
    "foreign_signatures",
    """SELECT event_type AS run_signature, count(*)::BIGINT AS n FROM events
       WHERE event_type <> 'click' GROUP BY event_type""",
)
def foreign_signatures(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("run_signature"))
    return align.foreign_signatures(rows, "click")


_TEXT_KEY = "substr(sha256(text), 1, 24)"
_COVERAGE_SQL = f"""
e AS (SELECT doc_id::VARCHAR AS id FROM documents),
p AS (SELECT (doc_id + quality * 3)::VARCHAR AS id FROM labels
      UNION ALL SELECT doc_id::VARCHAR FROM documents WHERE lang = 'en'),
i AS (SELECT id, CASE WHEN pn = 0 THEN 'missing' WHEN en = 0 THEN 'extra'
        WHEN pn > 1 THEN 'duplicate' END AS issue FROM (
        SELECT id, sum(e) AS en, sum(p) AS pn FROM (SELECT id, 1 AS e, 0 AS p FROM e UNION ALL
          SELECT id, 0, 1 FROM p) GROUP BY id))
"""


def _coverage(spark, folder):
    docs = table(spark, folder, "documents")
    expected = docs.select(F.col("doc_id").cast("string").alias("id"))
    shards = (
        table(spark, folder, "labels")
        .select((F.col("doc_id") + F.col("quality") * 3).cast("string").alias("id"))
        .unionByName(docs.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id")))
    )
    return align.shard_coverage(expected, shards)


@query("shard_coverage", f"WITH {_COVERAGE_SQL} SELECT id, issue FROM i WHERE issue IS NOT NULL")
def shard_coverage(spark, folder):
    return _coverage(spark, folder)


@query(
    "coverage_summary",
    f"""WITH {_COVERAGE_SQL} SELECT issue, count(*)::BIGINT AS n,
        array_to_string(list_slice(list(id ORDER BY id), 1, 5), ',') AS preview
        FROM i WHERE issue IS NOT NULL GROUP BY issue""",
)
def coverage_summary(spark, folder):
    return align.coverage_summary(_coverage(spark, folder))


def _shards(spark, folder):
    """Suppliers as evaluation shards, grouped by nation."""
    return table(spark, folder, "supplier").select(
        F.col("s_nationkey").cast("string").alias("label"),
        F.lit("base").alias("model"),
        F.when(F.col("s_acctbal") > 5000, "r2").otherwise("r1").alias("model_revision"),
        F.concat(F.lit("/mnt/"), F.col("s_suppkey").cast("string"), F.lit("/adapter")).alias("adapter"),
        F.sha2(F.lit("adapter"), 256).alias("adapter_sha256"),
        F.array(F.concat(F.lit("/data/"), F.col("s_suppkey").cast("string"), F.lit("/eval.jsonl"))).alias(
            "manifests"
        ),
    )


@query(
    "shard_identity",
    """SELECT s_nationkey::VARCHAR AS label, count(DISTINCT s_acctbal > 5000)::BIGINT AS identities,
       count(DISTINCT s_acctbal > 5000) = 1 AS consistent FROM supplier GROUP BY s_nationkey""",
)
def shard_identity(spark, folder):
    return align.shard_identity(_shards(spark, folder)).select("label", "identities", "consistent")


@query(
    "shard_selection_issues",
    """SELECT l_orderkey AS label, count(*)::BIGINT AS shards,
         count(DISTINCT l_linenumber)::BIGINT AS indices FROM lineitem GROUP BY l_orderkey
       HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1
         OR max(l_linenumber) <> count(*)""",
)
def shard_selection_issues(spark, folder):
    """Line numbers taken as shard indices: orders whose lines are not 1 … n."""
    line = table(spark, folder, "lineitem")
    # an order has a few lines: one sort counts them, where a join would hold them again
    shards = line.select(
        F.col("l_orderkey").alias("label"), (F.col("l_linenumber") - 1).alias("shard_index"),
        F.count(F.lit(1)).over(W.partitionBy("l_orderkey")).alias("num_shards"),
    )
    return align.shard_selection_issues(shards).select("label", "shards", "indices")


@query(
    "merge_predictions",
    """SELECT d.doc_id AS id, d.doc_id AS order_key, l.quality AS prediction,
       'shard-' || (d.doc_id % 4)::VARCHAR AS source_evaluation_label,
       'merged' AS evaluation_label, 'sig' AS run_signature
       FROM documents d JOIN labels l USING (doc_id)""",
)
def merge_predictions(spark, folder):
    labels = table(spark, folder, "labels")
    expected = table(spark, folder, "documents").join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("order_key")
    )
    shard = F.concat(F.lit("shard-"), (F.col("doc_id") % 4).cast("string"))
    predictions = labels.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("prediction"),
        shard.alias("evaluation_label"), shard.alias("run_signature"),
    )
    merged = align.merge_predictions(expected, predictions, "merged", "sig")
    return merged.select(
        "id", "order_key", "prediction", "source_evaluation_label", "evaluation_label",
        "run_signature",
    )


def _locators(spark, folder):
    docs = B.document_records(spark, folder)
    kind = F.when(F.col("website_category") == "de", "arrow_single_image").otherwise("single_image")
    fields = {
        "dataset": F.lit("documents"),
        "revision": F.col("website_category"),
        "file": F.concat("source", F.lit(".parquet")),
        "row_group": (F.col("n_chars") % 5).cast("int"),
        "kind": kind,
        "screenshot": F.col("image"),
    }
    located = docs.withColumn("locator", records.image_locator(fields))
    return located.select(
        "id", records.locator_id(F.col("locator")).alias("locator_id"),
        "locator.dataset", "locator.revision", "locator.file", "locator.row_group", "locator.kind",
        F.col("image").alias("screenshot"), "domain",
    )


_LOCATOR_SQL = f"""
r AS ({B.DOCUMENTS_SQL}),
l0 AS (SELECT id, domain, 'documents' AS dataset, website_category AS revision,
  source || '.parquet' AS file, (n_chars % 5)::INT AS row_group, image AS screenshot,
  CASE WHEN website_category = 'de' THEN 'arrow_single_image' ELSE 'single_image' END AS kind FROM r),
l AS (SELECT *, substr(sha256('{{"dataset":"documents","file":"' || file || '","kind":"' || kind
  || '","revision":"' || revision || '","row_group":' || row_group::VARCHAR || ',"screenshot":"'
  || screenshot || '"}}'), 1, 24) AS locator_id FROM l0)
"""


@query("image_locator", f"WITH {_LOCATOR_SQL} SELECT id, locator_id FROM l")
def image_locator(spark, folder):
    return _locators(spark, folder).select("id", "locator_id")


@query(
    "locator_groups",
    f"""WITH {_LOCATOR_SQL} SELECT dataset, revision, file,
        (CASE WHEN kind = 'arrow_single_image' THEN -1 ELSE row_group END)::INT AS row_group,
        count(DISTINCT locator_id)::BIGINT AS locators FROM l GROUP BY 1, 2, 3, 4""",
)
def locator_groups(spark, folder):
    return align.locator_groups(_locators(spark, folder))


_INDEX_SQL = """
x AS (SELECT DISTINCT locator_id, screenshot AS image FROM l WHERE right(screenshot, 5) > '4.jpg'),
i AS (SELECT locator_id, image, sha256(image) AS jpeg_sha256,
  (1000 + length(image))::BIGINT AS jpeg_bytes FROM x)
"""


def _index(spark, folder):
    """Images of most locators; the rest are missing on purpose."""
    have = _locators(spark, folder).where(F.substring("screenshot", -5, 5) > "4.jpg")
    return have.select("locator_id", F.col("screenshot").alias("image")).distinct().select(
        "locator_id", "image", F.lit(1280).alias("image_width"), F.lit(720).alias("image_height"),
        F.sha2("image", 256).alias("jpeg_sha256"),
        (F.lit(1000) + F.length("image")).cast("bigint").alias("jpeg_bytes"),
    )


@query(
    "materialize_manifest",
    f"""WITH {_LOCATOR_SQL}, {_INDEX_SQL} SELECT l.id, l.locator_id, i.image AS image_path,
        i.jpeg_sha256, i.jpeg_bytes FROM l LEFT JOIN i USING (locator_id)""",
)
def materialize_manifest(spark, folder):
    rows = align.materialize_manifest(_locators(spark, folder), _index(spark, folder))
    return rows.select("id", "locator_id", "image_path", "jpeg_sha256", "jpeg_bytes")


@query(
    "materialize_bucketed",
    f"""WITH {_LOCATOR_SQL}, {_INDEX_SQL} SELECT l.id, l.locator_id, i.image AS image_path,
        i.jpeg_sha256, i.jpeg_bytes FROM l LEFT JOIN i USING (locator_id)""",
)
def materialize_bucketed(spark, folder):
    """The manifest joined with an index that is stored in buckets of locators."""
    path = scratch(spark, "image-index")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    index = align.store_image_index(_index(spark, folder), name, path, 16)
    rows = align.materialize_manifest(_locators(spark, folder), index)
    return rows.select("id", "locator_id", "image_path", "jpeg_sha256", "jpeg_bytes")


@query(
    "unmaterialized",
    f"""WITH {_LOCATOR_SQL}, {_INDEX_SQL} SELECT DISTINCT locator_id FROM l
        WHERE locator_id NOT IN (SELECT locator_id FROM i)""",
)
def unmaterialized(spark, folder):
    return align.unmaterialized(_locators(spark, folder), _index(spark, folder))


@query(
    "materialization_summary",
    f"""WITH {_LOCATOR_SQL}, {_INDEX_SQL}, g AS (SELECT DISTINCT dataset, revision, file,
          CASE WHEN kind = 'arrow_single_image' THEN -1 ELSE row_group END AS rg FROM l),
    w AS (SELECT DISTINCT locator_id FROM l)
    SELECT (SELECT count(*) FROM g)::BIGINT AS groups, count(*)::BIGINT AS unique_images,
      count(*) FILTER (jpeg_bytes IS NULL)::BIGINT AS missing_images,
      coalesce(sum(jpeg_bytes), 0)::BIGINT AS image_bytes FROM w LEFT JOIN i USING (locator_id)""",
)
def materialization_summary(spark, folder):
    return audit.materialization_summary(_locators(spark, folder), _index(spark, folder))


def _checkpoints(spark, folder):
    """Image checkpoints of two workers; copies of a text differ in size where their source does."""
    docs = B.document_records(spark, folder)
    return docs.select(
        F.col("image").alias("locator_id"), "image", F.lit(1280).alias("image_width"),
        F.lit(720).alias("image_height"), F.sha2("image", 256).alias("jpeg_sha256"),
        F.length("source").cast("bigint").alias("jpeg_bytes"),
    )


@query(
    "image_index_conflicts",
    """SELECT 'images/' || substr(sha256(text), 1, 24) || '.jpg' AS locator_id FROM documents
       GROUP BY 1 HAVING min(length(source)) <> max(length(source))""",
)
def image_index_conflicts(spark, folder):
    return align.image_index_conflicts(_checkpoints(spark, folder))


@query(
    "image_index_merge",
    f"""WITH r AS ({B.EVENTS_SQL}) SELECT DISTINCT trajectory_id AS locator_id,
        'images/' || trajectory_id AS image FROM r""",
)
def image_index_merge(spark, folder):
    rows = B.event_records(spark, folder).select(
        F.col("trajectory_id").alias("locator_id"),
        F.concat(F.lit("images/"), "trajectory_id").alias("image"),
    )
    return align.image_index_merge(rows)


_LINES = "string_split(text, chr(10))"


@query(
    "trajectory_image_lookup",
    f"""WITH d AS (SELECT doc_id::VARCHAR AS sample_id, {_LINES} AS parts FROM documents),
    w AS (SELECT sample_id, 'shots/screenshot_' || lpad(n::VARCHAR, 3, '0') || '.png' AS screenshot,
        n::BIGINT AS n, len(parts) AS have FROM d, (SELECT unnest([1, 2, 3]) AS n))
    SELECT sample_id, screenshot, CASE WHEN n <= have THEN n - 1 END::INT AS image_index,
      CASE WHEN n <= have THEN CASE WHEN n % 2 = 0 THEN 'deep/' ELSE '' END || 'screenshot_'
        || lpad(n::VARCHAR, 3, '0') || '.png' END AS path FROM w""",
)
def trajectory_image_lookup(spark, folder):
    """Each line of a text is a screenshot; even ones name a path, odd ones fall back to a number."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.split("text", "\n").alias("parts")
    )

    def name(i):
        return F.format_string("deep/screenshot_%03d.png", i + 1)

    rows = docs.select(
        "sample_id",
        F.transform("parts", lambda _, i: F.struct(F.lit(None).cast("string").alias("path"))).alias(
            "images"
        ),
        F.transform("parts", lambda _, i: F.when(i % 2 == 1, name(i))).alias("image_paths"),
    )
    wanted = docs.select(
        "sample_id", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("n")
    ).select("sample_id", F.format_string("shots/screenshot_%03d.png", "n").alias("screenshot"))
    return align.trajectory_image_lookup(rows, wanted)


@query(
    "job_results",
    """SELECT status, count(*)::BIGINT AS jobs FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'pending'
         WHEN l.quality = 1 THEN 'complete' ELSE 'failed' END AS status
       FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status""",
)
def job_results(spark, folder):
    jobs = table(spark, folder, "documents").select(F.col("doc_id").alias("job_id"), "lang")
    labels = table(spark, folder, "labels")
    results = labels.select(
        F.col("doc_id").alias("job_id"),
        F.when(F.col("quality") == 1, "complete").otherwise("failed").alias("status"),
    )
    states = labels.select(F.col("doc_id").alias("job_id"), F.col("toxic").alias("step"))
    return align.status_counts(align.job_results(jobs, results, states))


# ---- set operations ---------------------------------------------------------------------------


def _sides(spark, folder):
    """Documents as training, benchmark items as evaluation; the text decides identity."""
    docs = table(spark, folder, "documents").select(
        F.substring(F.sha2("text", 256), 1, 24).alias("id"),
        F.when(F.col("n_chars") % 11 == 0, "unknown").otherwise(F.upper("source")).alias("domain"),
    )
    bench = table(spark, folder, "benchmark").select(
        F.substring(F.sha2("text", 256), 1, 24).alias("id"),
        F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("domain"),
    )
    return docs, bench


_SIDES_SQL = f"""
t AS (SELECT {_TEXT_KEY} AS id, CASE WHEN n_chars % 11 = 0 THEN 'unknown' ELSE source END AS domain
      FROM documents),
e AS (SELECT {_TEXT_KEY} AS id, 'src' || (item_id % 30)::VARCHAR AS domain FROM benchmark),
o AS (SELECT 'id' AS kind, id AS key FROM (SELECT id FROM t INTERSECT SELECT id FROM e)
  UNION ALL SELECT 'sampling_unit', 'record:' || id FROM (SELECT id FROM t INTERSECT SELECT id FROM e)
  UNION ALL SELECT 'known_domain', domain FROM (SELECT domain FROM t WHERE domain <> 'unknown'
    INTERSECT SELECT domain FROM e))
"""


@query(
    "leakage_audit",
    f"""WITH {_SIDES_SQL} SELECT
      (SELECT count(*) FROM o WHERE kind = 'id')::BIGINT AS id_overlap_count,
      (SELECT count(*) FROM o WHERE kind = 'sampling_unit')::BIGINT AS sampling_unit_overlap_count,
      (SELECT count(*) FROM o WHERE kind = 'known_domain')::BIGINT AS known_domain_overlap_count,
      (SELECT count(*) FROM t)::BIGINT AS training_examples,
      (SELECT count(*) FROM t WHERE domain = 'unknown')::BIGINT AS training_unknown_domains,
      (SELECT count(*) FROM e)::BIGINT AS evaluation_examples,
      (SELECT count(*) FROM e WHERE domain = 'unknown')::BIGINT AS evaluation_unknown_domains""",
)
def leakage_audit(spark, folder):
    return setops.leakage_audit(*_sides(spark, folder))


@query(
    "leakage_preview",
    f"""WITH {_SIDES_SQL} SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key)::INT
        AS position FROM o QUALIFY position <= 20""",
)
def leakage_preview(spark, folder):
    return setops.leakage_preview(*_sides(spark, folder))


REQUIRED = {
    "iid": ("id", "sampling_unit"),
    "domain_balanced": ("id", "sampling_unit", "known_domain"),
}


@query(
    "required_disjoint",
    f"""WITH r AS ({SPLIT_SQL}), t AS (SELECT * FROM r WHERE split = 'train'),
    s AS (SELECT *, CASE split WHEN 'validation' THEN 'iid' ELSE 'domain_balanced' END AS suite
      FROM r WHERE split <> 'train'),
    k AS (SELECT DISTINCT suite, 'id' AS kind, id AS key FROM s
      UNION SELECT suite, 'sampling_unit', unit FROM s
      UNION SELECT suite, 'known_domain', domain FROM s
        WHERE domain <> 'unknown' AND suite = 'domain_balanced'),
    tk AS (SELECT 'id' AS kind, id AS key FROM t UNION SELECT 'sampling_unit', unit FROM t
      UNION SELECT 'known_domain', domain FROM t WHERE domain <> 'unknown')
    SELECT suite, kind, count(*)::BIGINT AS overlap FROM k JOIN tk USING (kind, key) GROUP BY ALL""",
)
def required_disjoint(spark, folder):
    rows = split_documents(spark, folder)
    suite = F.when(F.col("split") == "validation", "iid").otherwise("domain_balanced")
    suites = rows.where("split <> 'train'").withColumn("suite", suite)
    return setops.required_disjoint(rows.where("split = 'train'"), suites, REQUIRED)


@query(
    "union_manifests",
    f"""SELECT manifest, count(*)::BIGINT AS n, count(domain)::BIGINT AS with_domain,
        count(url)::BIGINT AS with_url FROM (
          SELECT 'pages' AS manifest, id, domain, url FROM ({B.PAGES_SQL})
          UNION ALL SELECT 'documents', id, domain, NULL FROM ({B.DOCUMENTS_SQL})
          UNION ALL SELECT 'events', id, domain, NULL FROM ({B.EVENTS_SQL})) GROUP BY manifest""",
)
def union_manifests(spark, folder):
    merged = setops.union_manifests(
        {
            "pages": B.page_records(spark, folder),
            "documents": B.document_records(spark, folder),
            "events": B.event_records(spark, folder),
        }
    )
    return merged.groupBy("manifest").agg(
        F.count(F.lit(1)).alias("n"), F.count("domain").alias("with_domain"),
        F.count("url").alias("with_url"),
    )


@query(
    "combine_tasks",
    f"""SELECT id, split, task_manifest, {sql_key(f"'{B.SEED}'", 'split', 'id')} AS shuffle_key FROM (
          SELECT id, split, task AS task_manifest FROM ({SPLIT_SQL}) WHERE task <> 'action')""",
)
def combine_tasks(spark, folder):
    rows = split_documents(spark, folder)
    parts = {task: rows.where(F.col("task") == task) for task in ("qa", "grounding")}
    return setops.combine_tasks(parts, B.SEED).select("id", "split", "task_manifest", "shuffle_key")


@query(
    "unique_ids",
    f"SELECT id, count(*)::BIGINT AS n FROM (SELECT {_TEXT_KEY} AS id FROM documents) "
    "GROUP BY id HAVING count(*) > 1",
)
def unique_ids(spark, folder):
    docs, _ = _sides(spark, folder)
    return setops.unique_ids(docs)


@query(
    "selected_records",
    """WITH u AS (SELECT doc_id AS id, 'tier' AS origin, lang AS value, 0 AS p FROM documents
       UNION ALL SELECT doc_id, 'suite', 'q' || quality::VARCHAR, 1 FROM labels)
    SELECT id, origin, value FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC) = 1""",
)
def selected_records(spark, folder):
    tier = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.lit("tier").alias("origin"), F.col("lang").alias("value")
    )
    suite = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.lit("suite").alias("origin"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"),
    )
    return setops.selected_records([tier, suite])


@query(
    "record_id",
    f"""SELECT doc_id, substr(sha256(concat_ws(chr(31), 'documents', doc_id, lang)), 1, 24) AS id,
        {sql_mod(10, "'documents'", 'doc_id')} AS bucket FROM documents""",
)
def record_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return docs.select(
        "doc_id",
        hashing.record_id("documents", F.col("doc_id"), F.col("lang")).alias("id"),
        hashing.stable_mod(10, "documents", F.col("doc_id")).alias("bucket"),
    )
