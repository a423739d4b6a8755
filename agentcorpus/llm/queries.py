"""The registered queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus.llm import (
    filteraudit, hilbert, langid, licences, lines, ordermin, packing, pieces, simhash, topk, warc, webtext, whitening,
)
from agentcorpus.llm.store import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


@query
def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign_shards(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the merge ranks of byte_bpe_50k.json: the same ids
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


ORACLES["op8_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return webtext.extract(pages.select("page_id", "url", "html")).drop("html")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stored(simhash.fingerprint_edits(table(spark, sf_dir, "documents")), "simhash")
    return simhash.count_near(marked, F.col("doc_id") % 100 == 0).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_text(F.col("a"), F.col("b")).alias("fingerprint"),
        simhash.as_text(F.col("ea"), F.col("eb")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "near_docs",
    )


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "lines_in", "lines_kept")


ORACLES["op1_line_dedup"] = """
WITH split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE text IS NOT NULL
),
lines AS (
    SELECT doc_id, pos, line,
           trim(lower(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS norm
    FROM split
),
firsts AS (
    SELECT norm, min((doc_id, pos)) AS place FROM lines WHERE norm <> '' GROUP BY norm
),
halves AS (
    SELECT norm, place, b, 'head' AS side, left(norm, b // 2) AS half
    FROM firsts, unnest([length(norm), length(norm) - 1]) AS u(b) WHERE length(norm) >= 16
    UNION ALL
    SELECT norm, place, b, 'tail', right(norm, b - b // 2)
    FROM firsts, unnest([length(norm), length(norm) - 1]) AS u(b) WHERE length(norm) >= 16
),
near AS (
    SELECT DISTINCT y.norm
    FROM halves AS x JOIN halves AS y USING (b, side, half)
    WHERE x.place < y.place AND levenshtein(x.norm, y.norm) <= 1
),
judged AS (
    SELECT l.*, l.norm <> '' AND f.place = (l.doc_id, l.pos) AND n.norm IS NULL AS stays
    FROM lines AS l LEFT JOIN firsts AS f ON l.norm = f.norm LEFT JOIN near AS n ON l.norm = n.norm
),
built AS (
    SELECT doc_id,
           count(*) FILTER (WHERE norm <> '')::INTEGER AS lines_in,
           count(*) FILTER (WHERE stays)::INTEGER AS lines_kept,
           string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays OR norm = '') AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL WHEN b.lines_kept > 0 THEN b.text ELSE '' END AS text,
       coalesce(b.lines_in, 0) AS lines_in, coalesce(b.lines_kept, 0) AS lines_kept
FROM documents AS d LEFT JOIN built AS b USING (doc_id)
"""


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordermin.near_duplicates(docs).select("doc_id", "class_id", "stays", "class_key")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode(docs, model, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.translate("text", pieces.BLANK, " ")).alias("round_trip"),
    )


@query
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.fit(docs))
    return found.where("confirmed").select("doc_id", "line", "family", "probability", "overlap")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = """
WITH RECURSIVE orders AS (
    SELECT '' AS filter_order
    UNION ALL
    SELECT filter_order || letter
    FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(letter)
    WHERE NOT contains(filter_order, letter)
),
steps AS (
    SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter,
           substr(filter_order, 1, step - 1) AS before
    FROM orders, unnest([1, 2, 3, 4, 5]) AS u(step) WHERE length(filter_order) = 5
),
texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words
    FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
),
judged AS (
    SELECT t.part,
           CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g')))
                        > 10 * length(t.text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN f.first < t.doc_id THEN 'E' ELSE '' END AS fails,
           coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
    FROM texts AS t JOIN firsts AS f ON f.text = t.text LEFT JOIN marks AS m ON m.doc_id = t.doc_id
),
kinds AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
counts AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE own AND gone), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
           coalesce(sum(n) FILTER (WHERE own AND NOT gone AND good), 0)::BIGINT AS good_lost,
           coalesce(sum(n) FILTER (WHERE own AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
    FROM (
        SELECT *, contains(fails, letter) AS own, translate(fails, before, '') <> fails AS gone
        FROM kinds, steps
    )
    GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counts
"""


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op13_warc"] = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest
    FROM pages
),
firsts AS (SELECT digest, min(page_id) AS first FROM payloads GROUP BY digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1, 1)
           FOR i IN range(32)
       ], '') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM payloads JOIN firsts USING (digest)
"""


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
