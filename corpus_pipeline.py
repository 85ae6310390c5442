"""From documents to token ids: language, near-duplicates, secrets, mixture, encoding. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendwarden.llm import bpe_backtrack, dart_minhash, lang_crf, secret_tests, source_mix
from spendwarden.llm.store import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: null, empty and letterless texts, and texts whose words no lexicon knows. Repeated rows are judged alike; an empty table stays empty."""
    return lang_crf.known_only(docs, lang_crf.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays; of repeated rows one, null texts as the operator says."""
    return dart_minhash.first_of_class(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null texts as null."""
    return secret_tests.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; empty and null texts have no size and count once or not at all, as their source's rate says."""
    return source_mix.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of each row; null and empty texts have no tokens."""
    return bpe_backtrack.encode(docs)


STAGES = [
    ("language", known_language),
    ("near-duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("encoding", encoded),
]
ORACLE_SQL = None  # the fields, signatures and merges of the stages can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
