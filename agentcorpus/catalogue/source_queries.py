"""Readers, writers and checks, on files that Spark writes from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from agentcorpus.catalogue import bindings as B
from agentcorpus.catalogue.base import query, rounded, scratch, table
from agentcorpus.catalogue.expansion_queries import raw_screenshots, raw_trajectories
from agentcorpus.operators import records, study, website
from agentcorpus.session import cut
from agentcorpus.sources import arrow_shards, checksums, manifests, progress, scans

ODD_NAME = "of 50% a+b"  # folders with characters that listings encode


@query(
    "manifest_round_trip",
    f"""SELECT id, domain, source, website_category, application_focused, task, image, order_key
        FROM ({B.DOCUMENTS_SQL})""",
)
def manifest_round_trip(spark, folder):
    path = scratch(spark, "manifest")
    manifests.write_manifest(B.document_records(spark, folder), path)
    return manifests.read_manifest(spark, path).select(
        "id", "domain", "source", "website_category", "application_focused", "task", "image",
        "order_key",
    )


@query(
    "read_episodes",
    """SELECT 'valid' AS part, doc_id::VARCHAR AS id, len(string_split(text, chr(10)))::INTEGER AS steps,
         NULL::BIGINT AS line FROM documents
       UNION ALL SELECT 'invalid', doc_id::VARCHAR, NULL,
         row_number() OVER (PARTITION BY quality ORDER BY doc_id)::BIGINT FROM labels""",
)
def read_episodes(spark, folder):
    """One episode per document, and a log of broken lines for each quality of the labels."""
    path = scratch(spark, f"episodes {ODD_NAME}")
    docs = table(spark, folder, "documents")
    steps = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            i.alias("step_index"), line.alias("raw_policy_output"),
            F.lit(None).cast("string").alias("parse_error"), (i % 2 == 0).alias("success"),
        ),
    )
    episodes = docs.select(F.col("doc_id").cast("string").alias("episode_id"), steps.alias("steps"))
    manifests.append_episodes(episodes, f"{path}/good")
    valid, _ = manifests.read_episodes(spark, f"{path}/good")
    broken = F.concat(F.lit('{"episode_id": '), F.col("doc_id").cast("string"), F.lit(", broken"))
    labels = table(spark, folder, "labels").select("doc_id", "quality", broken.alias("value"))
    # one file per quality, in the order of ids, so that line numbers are known
    labels.repartition("quality").sortWithinPartitions("quality", "doc_id").select(
        "quality", "value"
    ).write.partitionBy("quality").text(f"{path}/bad")
    _, invalid = manifests.read_episodes(spark, f"{path}/bad")
    return valid.select(
        F.lit("valid").alias("part"), F.col("episode_id").alias("id"),
        F.size("steps").alias("steps"), F.lit(None).cast("bigint").alias("line"),
    ).unionByName(
        invalid.select(
            F.lit("invalid").alias("part"),
            F.regexp_extract("_bad", ": ([0-9]+),", 1).alias("id"),
            F.lit(None).cast("int").alias("steps"), F.col("_line").alias("line"),
        )
    )


@query(
    "read_receipts",
    f"""WITH c AS ({B.CANDIDATES_SQL}) SELECT run_id, size, seed, step, suite, task, metric,
        round(value, 6) AS value FROM c""",
)
def read_receipts(spark, folder):
    """Nested receipts written from the long metrics and read back."""
    path = scratch(spark, "receipts")
    metrics = B.candidate_metrics(spark, folder).withColumns(
        {"control": F.lit("sft"), "model": F.lit("base"), "model_revision": F.lit("r1")}
    )
    counts = metrics.select(
        *[c for c in metrics.columns if c not in ("metric", "value")]
    ).distinct().withColumns({"metric": F.lit("examples"), "value": F.lit(10.0)})
    manifests.write_manifest(
        manifests.receipts_from_metrics(metrics.unionByName(counts)), path
    )
    return rounded(
        manifests.read_receipts(spark, path).select(
            "run_id", "size", "seed", "step", "suite", "task", "metric", "value"
        )
    )


@query(
    "scan_trajectories",
    """SELECT CASE WHEN n % 4 = 0 THEN 'malformed_row' WHEN n % 4 = 1 THEN 'no_valid_examples' END
         AS reason, count(*)::BIGINT AS n FROM (SELECT n_chars AS n FROM documents) GROUP BY 1""",
)
def scan_trajectories(spark, folder):
    """Rows whose step keys are not numbers or whose goal is empty are rejected with a reason."""
    return _judged_trajectories(spark, folder).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _judged_trajectories(spark, folder):
    path = scratch(spark, f"trajectories {ODD_NAME}")
    n = F.col("n_chars")
    raw = raw_trajectories(spark, folder).join(
        table(spark, folder, "documents").select(
            F.col("doc_id").cast("string").alias("sample_id"), "n_chars"
        ),
        "sample_id",
    )
    empty = F.lit('{"goal":"","high_level":"","mid_level":"","low_level":""}')
    spoiled = raw.withColumns(
        {
            "trajectory": F.when(n % 4 == 0, '{"first":{}}').when(n % 4 == 1, '{"0":{}}').otherwise(
                F.col("trajectory")
            ),
            "instruction": F.when(n % 4 == 1, empty).when(
                n % 4 > 1, F.lit('{"goal":"g"}')
            ).otherwise(F.col("instruction")),
        }
    ).drop("n_chars")
    spoiled.write.parquet(path)
    return scans.rejected_trajectories(scans.scan_trajectories(spark, path, "docs", "r1"))


@query(
    "write_scanned",
    """WITH r AS (SELECT CASE WHEN n_chars % 4 = 0 THEN 'malformed_row' WHEN n_chars % 4 = 1
         THEN 'no_valid_examples' ELSE 'accepted' END AS name FROM documents)
    SELECT name, count(*)::BIGINT AS n FROM r GROUP BY name UNION ALL SELECT 'rows', count(*) FROM r
    UNION ALL SELECT 'written', count(*) FROM r WHERE name = 'accepted'""",
)
def write_scanned(spark, folder):
    """Counts taken by the pass that writes the accepted rows, and the rows it wrote."""
    path = scratch(spark, "accepted")
    judged = _judged_trajectories(spark, folder).select("sample_id", "file", "row_index", "reason")
    counts = {name: n for name, n in scans.write_scanned(judged, path).items() if n}
    found = spark.createDataFrame(list(counts.items()), "name string, n bigint")
    written = spark.read.parquet(path).agg(F.lit("written").alias("name"), F.count(F.lit(1)).alias("n"))
    return found.unionByName(written)


@query(
    "rejection_summary",
    """SELECT lang AS source, CASE WHEN n_chars % 3 = 0 THEN 'no_valid_steps' ELSE 'split_full' END
         AS reason, count(*)::BIGINT AS n FROM documents WHERE n_chars % 3 < 2 GROUP BY ALL""",
)
def rejection_summary(spark, folder):
    n = F.col("n_chars") % 3
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("source"),
        F.when(n == 0, "no_valid_steps").when(n == 1, "split_full").alias("reason"),
    )
    return scans.rejection_summary(rows)


@query(
    "scan_screenshots",
    """WITH l AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT 'https://' || source || '.example.com/x' AS url, sha256(line) AS question,
      CASE WHEN length(line) % 4 = 0 THEN ' ' ELSE lang END AS answer, count(*)::BIGINT AS messages,
      NULL::BIGINT AS rows FROM l GROUP BY ALL
    UNION ALL SELECT NULL, NULL, NULL, NULL, count(*)::BIGINT FROM documents""",
)
def scan_screenshots(spark, folder):
    """Every scanned message, counted by its texts, and the rows that the places in files tell apart."""
    path = scratch(spark, f"screenshots {ODD_NAME}")
    raw_screenshots(spark, folder).withColumn("image", F.encode("metadata.url", "utf-8")).write.parquet(
        path
    )
    scanned = scans.scan_screenshots(spark, path, "docs", "r1")
    messages = scanned.select(F.col("metadata.url").alias("url"), F.explode("messages").alias("m"))
    counted = messages.groupBy(
        "url", F.sha2("m.question", 256).alias("question"), F.col("m.answer").alias("answer")
    ).agg(F.count(F.lit(1)).alias("messages"))
    rows = scanned.agg(F.count_distinct(F.struct("file", "row_index")).alias("rows"))
    return counted.unionByName(rows, allowMissingColumns=True)


@query(
    "scan_arrow",
    "SELECT doc_id, lang, n_chars, sha256(text) AS text_hash FROM documents",
)
def scan_arrow(spark, folder):
    """Documents written as Arrow shards, scanned with one column projected away."""
    shards = scratch(spark, "arrow")
    docs = table(spark, folder, "documents").repartition(8, "doc_id")
    # The write runs once; its list of paths is stored so that a later read cannot repeat it.
    listing = cut(arrow_shards.write_arrow_shards(docs, shards, rows=50))
    rows = arrow_shards.scan_arrow(
        spark, listing, ["doc_id", "lang", "n_chars", "text"],
        "doc_id bigint, lang string, n_chars bigint, text string",
        plan=arrow_shards.plan_arrow(listing, 1 << 18),
    )
    return rows.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_hash"))


SHARDS, BATCH_ROWS = 8, 20


@query(
    "scan_arrow_rejects",
    f"""WITH d AS (SELECT doc_id, doc_id % 5 AS kind, doc_id // 5 % {SHARDS} AS shard FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY kind, shard ORDER BY doc_id) - 1 AS place,
            count(*) OVER (PARTITION BY kind, shard) AS size FROM d),
    j AS (SELECT *, (size - 1) // {BATCH_ROWS} * {BATCH_ROWS} AS whole FROM n),
    k AS (SELECT kind, CASE WHEN kind IN (0, 1) THEN 'read' WHEN kind = 2 AND place < whole THEN 'read'
            WHEN kind = 2 AND place = whole THEN 'cut_off' WHEN kind = 3 AND place = 0 THEN 'empty'
            WHEN kind = 4 AND place = 0 THEN 'columns' END AS reason,
          shard, place, CASE WHEN kind < 3 AND (kind < 2 OR place < whole) THEN doc_id END AS doc_id FROM j)
    SELECT kind::INTEGER AS kind, reason, count(*)::BIGINT AS n, sum(place)::BIGINT AS places,
      sum(doc_id)::BIGINT AS ids FROM k WHERE reason IS NOT NULL GROUP BY kind, reason""",
)
def scan_arrow_rejects(spark, folder):
    """Shards of five kinds: streams, files, cut-off files, empty ones, and ones of another schema."""
    shards = scratch(spark, "arrow")
    docs = table(spark, folder, "documents").select(
        (F.col("doc_id") % 5).cast("int").alias("kind"),
        F.expr(f"doc_id div 5 % {SHARDS}").alias("shard"),
        "doc_id", "lang", "text",
    )

    def write(key, rows):
        """One shard of some kind: a (kind, shard) group holds a fortieth of the rows."""
        kind, name = key[0].as_py(), f"{key[0].as_py()}-{key[1].as_py()}.arrow"
        rows = rows.sort_by("doc_id").select(["lang", "text"] if kind == 4 else ["doc_id", "lang", "text"])
        sink = pa.BufferOutputStream()
        with (pa.ipc.new_stream if kind == 0 else pa.ipc.new_file)(sink, rows.schema) as writer:
            for start in range(0, rows.num_rows, BATCH_ROWS):
                batch = rows.slice(start, BATCH_ROWS).combine_chunks().to_batches()[0]
                last = start + BATCH_ROWS >= rows.num_rows
                if kind == 2 and last:
                    whole = sink.tell()
                writer.write_batch(batch)
        data = sink.getvalue().to_pybytes()
        data = data[: whole + 100] if kind == 2 else b"" if kind == 3 else data
        files_at, base = arrow_shards.open_path(shards)
        files_at.create_dir(base, recursive=True)
        with files_at.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
        return pa.table({"path": [f"{shards}/{name}"]})

    listing = cut(docs.groupBy("kind", "shard").applyInArrow(write, "path string"))
    found = arrow_shards.scan_arrow(
        spark, listing, ["doc_id", "text"], "doc_id bigint, text string", rejects=True,
        plan=arrow_shards.plan_arrow(listing, 1 << 16),
    )
    kind = F.regexp_extract("path", "([0-9])-[0-9]+[.]arrow$", 1).cast("int").alias("kind")
    return found.groupBy(kind, F.coalesce("reason", F.lit("read")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_index").alias("places"), F.sum("doc_id").alias("ids")
    )


@query(
    "scan_completeness",
    """SELECT doc_id::VARCHAR AS file, sha256(source) AS identity,
         CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 'other' ELSE sha256(source) END
           AS scanned_identity
       FROM documents LEFT JOIN labels USING (doc_id)
       WHERE quality IS NULL OR quality = 0 OR toxic = 1""",
)
def scan_completeness(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("file"), F.sha2("source", 256).alias("identity")
    )
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("file"), "quality", "toxic"
    )
    done = labels.join(docs, "file").select(
        "file", (F.col("toxic") == 0).alias("complete"),
        F.when(F.col("quality") == 0, "other").otherwise(F.col("identity")).alias("identity"),
    )
    return scans.scan_completeness(docs, done)


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
_TEXTS = ("documents", "pages", "conversations", "benchmark")


@query(
    "source_file_inventory",
    f"""SELECT name || '.parquet' AS file,
        CASE WHEN name IN {_TEXTS} THEN 'texts' ELSE 'facts' END AS source,
        CASE WHEN name IN {_TEXTS} THEN 'r1' ELSE 'r2' END AS source_revision,
        name NOT IN {_TEXTS} AS mismatch
        FROM (SELECT unnest({list(_TABLES)}) AS name)""",
)
def source_file_inventory(spark, folder):
    """Every given file under its source; the facts are pinned at a count that is not met."""
    texts = "|".join(_TEXTS)
    specs = spark.createDataFrame(
        [("texts", f"^({texts})[.]parquet", 4, "r1"), ("facts", f"^(?!{texts})[a-z]+[.]parquet", 99, "r2")],
        "id string, file_pattern string, expected_files int, source_revision string",
    )
    listed, wrong = checksums.source_file_inventory(spark, folder, specs)
    flagged = listed.join(
        wrong.select(F.col("id").alias("source"), F.lit(True).alias("mismatch")), "source", "left"
    )
    return flagged.select(
        "file", "source", "source_revision", F.coalesce("mismatch", F.lit(False)).alias("mismatch")
    )


@query(
    "content_checksums",
    """SELECT item_id, sha256(text || chr(10)) AS sha256, (strlen(text) + 1)::BIGINT AS bytes
       FROM benchmark""",
)
def content_checksums(spark, folder):
    """Every benchmark text as a file of its own; all have one base name, in different folders."""
    path = scratch(spark, f"texts {ODD_NAME}")
    items = table(spark, folder, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    files = checksums.content_checksums(spark, path).where(F.contains("file", F.lit("item_id=")))
    item = F.regexp_extract("file", "^item_id=([0-9]+)/part-", 1).cast("bigint")
    return files.where(item.isNotNull()).select(item.alias("item_id"), "sha256", "bytes")


_LINE = "'{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'"


@query(
    "table_fingerprint",
    f"""SELECT count(*)::BIGINT AS rows, sum(('0x' || substr(sha256({_LINE}), 1, 14))::UBIGINT)::VARCHAR
        AS fingerprint FROM documents""",
)
def table_fingerprint(spark, folder):
    return checksums.table_fingerprint(
        table(spark, folder, "documents"), ["source", "doc_id", "lang"]
    )


@query(
    "read_progress_log",
    """SELECT log, event, arg_max(completed, n)::BIGINT AS completed FROM (
         SELECT lang || '/' || (doc_id % 8)::VARCHAR AS log, doc_id AS n, CASE WHEN n_chars % 2 = 0 THEN 'start' ELSE 'complete' END
           AS event, n_chars AS completed, source FROM documents WHERE n_chars % 3 > 0)
       GROUP BY log, event""",
)
def read_progress_log(spark, folder):
    """Eight mixed logs per language: some lines hold an event behind a prefix, some are plain text."""
    path = scratch(spark, f"logs {ODD_NAME}")
    docs = table(spark, folder, "documents")
    event = F.when(F.col("n_chars") % 2 == 0, "start").otherwise("complete")
    stage = F.concat(F.lit("benchmark_"), "source")
    body = F.to_json(
        F.struct(
            event.alias("event"), stage.alias("stage"), F.col("n_chars").alias("completed"),
            F.lit("2024-01-01T00:00:00+00:00").alias("timestamp_utc"),
        )
    )
    line = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("note {not json "), "source")).otherwise(
        F.concat(F.lit("INFO "), body)
    )
    # all logs have one base name, and lines lie in the order of ids
    part = (F.col("doc_id") % 8).alias("part")
    docs.select(line.alias("value"), "lang", part, "doc_id").repartition("lang", "part").sortWithinPartitions(
        "lang", "part", "doc_id"
    ).drop("doc_id").write.partitionBy("lang", "part").text(path)
    last = progress.read_progress_log(spark, path)
    log = [F.regexp_extract("log", "^lang=([a-z]+)/part=([0-9])/part-", i) for i in (1, 2)]
    return last.select(F.concat_ws("/", *log).alias("log"), "event", "completed")


@query(
    "write_catalog",
    f"""WITH r AS ({B.ANNOTATED_SQL}), k AS (SELECT domain, website_category, count(*) AS n
        FROM r GROUP BY domain, website_category), m AS (SELECT domain, website_category,
        row_number() OVER (PARTITION BY domain ORDER BY n DESC, website_category) AS rn FROM k)
    SELECT website_category, count(*)::BIGINT AS websites,
      count(*) FILTER (website_category IN ({B.APPLICATIONS_SQL}))::BIGINT
        AS application_focused_websites FROM m WHERE rn = 1 GROUP BY website_category""",
)
def write_catalog(spark, folder):
    annotated = records.annotate_website(B.page_records(spark, folder), B.RULES)
    catalog = website.catalog_with_lists(
        website.website_catalog(annotated), website.catalog_dimensions(annotated)
    )
    path = scratch(spark, "catalog")
    manifests.write_catalog(catalog, path)
    written = spark.read.json(f"{path}/json")
    return written.groupBy("website_category").agg(
        F.count(F.lit(1)).alias("websites"),
        F.count_if("application_focused").alias("application_focused_websites"),
    )


@query(
    "write_payload",
    f"""WITH e AS ({B.EPISODES_SQL})
    SELECT 'variants' AS part, variant_id AS key, count(*)::DOUBLE AS first,
      round(avg(total_reward), 6) AS second FROM e GROUP BY variant_id
    UNION ALL SELECT 'pairs', c.task_id || ':' || c.seed::VARCHAR,
      n.success::INT::DOUBLE - c.success::INT::DOUBLE, round(n.total_reward - c.total_reward, 6)
      FROM e c JOIN e n USING (task_id, seed) WHERE c.variant_id = 'control' AND n.variant_id = 'candidate'""",
)
def write_payload(spark, folder):
    """Every row of a payload's two tables, as written and read again."""
    from agentcorpus.operators import align

    path = scratch(spark, "payload")
    episodes = B.paired_episodes(spark, folder)
    manifests.write_payload(
        {
            "variants": study.variant_summary(episodes),
            "pairs": align.pair_episodes(episodes, "control", "candidate"),
        },
        path,
    )
    variants = spark.read.parquet(f"{path}/variants").select(
        F.lit("variants").alias("part"), F.col("variant_id").alias("key"),
        F.col("episodes").cast("double").alias("first"), F.col("mean_reward").alias("second"),
    )
    pairs = spark.read.parquet(f"{path}/pairs").select(
        F.lit("pairs").alias("part"), F.concat_ws(":", "task_id", F.col("seed").cast("string")).alias("key"),
        F.col("success_delta").alias("first"), F.col("reward_delta").alias("second"),
    )
    return rounded(variants.unionByName(pairs))


@query(
    "seeded_source",
    "SELECT page_id, substr(sha256(concat_ws(chr(31), '53', 'pages', page_id::VARCHAR)), 1, 16) "
    "AS shuffle_key FROM pages",
)
def seeded_source(spark, folder):
    rows = scans.shuffled_source(
        spark, f"{folder}/pages.parquet", (B.SEED, "pages"), {"id": F.col("page_id").cast("string")}
    )
    return rows.select("page_id", "shuffle_key")
