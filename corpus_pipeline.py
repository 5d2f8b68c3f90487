"""Corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, BPE ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the table that the
stage before it wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe_codec, language_id, mixing, ngram_join, secrets
from lexloom.llm.common import BROADCAST_IDS, importable, sized, small_batches
from lexloom.session import checkpoint_dir

#: Near-duplicates of the corpus: five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _python_ready(spark: SparkSession) -> None:
    """Workers find the package and get texts in small batches, which bounds their memory."""
    importable(spark)
    small_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is clear; a null ``lang`` is filled with the prediction.

    Texts that are null or without letters, and those between two languages, are rejected.
    """
    _python_ready(spark)
    model = language_id.train(docs)
    named = language_id.with_language(docs, model)
    kept = named.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-duplicates, and one row of each id.

    Rows without an id belong to no group and stay.
    """
    _python_ready(spark)
    join = ngram_join.JaccardJoin(docs, SHINGLE, PERCENT)
    dropped = join.duplicates()
    kept = docs.join(sized(dropped, BROADCAST_IDS), docs["doc_id"] == dropped["id"], "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if twice:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text. No document goes."""
    found = secrets.find_secrets(docs, secrets.train(docs))
    text = F.when(F.col("text").isNotNull(), secrets.redacted(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    return (
        found.withColumn("text", text)
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*docs.columns)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights, in a global shuffle."""
    return mixing.mix(docs).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every copy."""
    _python_ready(spark)
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe_codec", encode_ids),
]

#: SQL cannot express the trained stages; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the folder the cluster shares."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
