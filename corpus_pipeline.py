"""A corpus pipeline: language, near-duplicates, benchmark passages, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import decontaminate, language_id, mixing, ngram_join, token_files
from knotwork.storage import materialize


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from labelled rows outside the held-out fold.

    Documents whose likeliest language has a score below 0.4 go, and with them null
    and empty texts and those without letters. Repeated rows share their fate.
    Without a labelled row no language is known, so nothing stays.
    """
    model = language_id.train(docs.filter(language_id.fold("doc_id") != 1))
    return language_id.keep_known(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Texts without words and rows without id stay; rows that repeat an id stay or go together.
    """
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; texts without words stay, equal rows share their fate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mixture of their sources takes them.

    Null sources are a source of their own; texts without words have size 0 and
    take places like others; equal rows take neighbouring places.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what reading them back gives for each.

    Null and empty texts are one end id; rows that repeat an id are written side
    by side. An empty table gives no files and no rows. Only id and text are used.
    """
    manifest, frequencies = token_files.write_token_files(docs)
    return token_files.read_token_files(manifest, frequencies)


STAGES = [
    ("language id", keep_languages),
    ("n-gram join", keep_one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mix),
    ("token files", write_tokens),
]

#: SQL expresses neither the trained language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
