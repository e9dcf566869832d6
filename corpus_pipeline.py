"""The corpus pipeline: unknown languages go, one of each group of near copies stays, benchmark leaks go, secrets are
blotted out, and what is left becomes token ids. Every stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import bpe, decontaminate, language_id, secret_scan, simhash
from strandwork.llm.common import shared_path
from strandwork.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found (9)."""
    return language_id.known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (7)."""
    return simhash.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (8)."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars counted anew (10)."""
    clean = secret_scan.redact(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text (5)."""
    return bpe.tokenized(docs, vocabulary_path(), keep=("doc_id", "lang", "source"), ids=True)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor XXH64 fingerprints nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
