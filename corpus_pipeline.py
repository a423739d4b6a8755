"""Four stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus.llm import langid, lines, ordermin, packing
from agentcorpus.llm.store import stored

LEAST_SCORE = 0.5  # posterior below which no language is more likely than all others
TOKENIZER = "byte_bpe_50k.tiktoken"


def with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` after a change of the text, its length kept in step."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.char_length("text").cast(kind))
    return changed.select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; null texts and texts without letters go."""
    found = langid.identify(docs)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)
    return found.where(known).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines; a document goes if none of its lines is left."""
    found = lines.dedup_lines(docs)
    return with_text(docs, found.where(F.col("lines_kept") > 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near duplicates."""
    return ordermin.near_duplicates(docs).where("stays").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]
ORACLE_SQL = None  # a trained classifier, sketches and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
