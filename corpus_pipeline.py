"""Cleaning a corpus in five stages, each on what the one before kept.

Toxic documents go; one document of each SimHash component stays; documents that hold a benchmark
window go; secrets are blotted out; what is left is encoded into SentencePiece pieces, and decoded
again as a check (round_trip). All stages but the last return the columns of documents; columns
whose names begin with two underscores and ``fw`` are reserved, others may have any name.

Documents are told apart by id and text. A null id or text is a value like any other: such rows are
judged by every stage, null texts as empty ones (they stay null). Of repeated rows one stays, as of
any near copies. Very long texts are judged whole. An empty table, of documents, labels or benchmark
items, passes through: no labels, no toxic rejections; no items, no contamination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import decontamination, pieces, secret_scan, simhash, toxicity
from fieldweave.llm.common import shared_path, text_key


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose id and text (by key) are not among the rejected."""
    gone = rejected.select(F.col("doc_id").alias("__fw_id"), F.col("tk").alias("__fw_gone")).distinct()
    keyed = docs.withColumn("__fw_tk", text_key(F.col("text")))
    return keyed.join(gone, keyed.doc_id.eqNullSafe(gone["__fw_id"]) & (F.col("__fw_tk") == gone["__fw_gone"]), "left_anti").drop("__fw_tk")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.score(docs, model).filter("predicted = 1"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast("long"))
    return clean.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).drop("ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_dedup", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("secret_scan", secrets_out),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Models and components can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None
