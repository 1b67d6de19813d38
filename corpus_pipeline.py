"""Corpus pipeline: from ``documents`` to packed training sequences in five stages.

Language identification drops documents without a recognisable language, the n-gram join
keeps one document of each group of near duplicates, decontamination cuts benchmark passages
out, the secret scan replaces secrets and linked credentials, and packing gives the pieces
with their sequences. Each stage's rows are written to the folder that all executors share
and read again by the next, so a lost executor costs no more than part of one stage. All but
the last stage return the columns of their input; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import decontaminate, language_id, ngram_join, packing, secrets
from claimwright.llm.blocks import saved

#: No SQL states language models, linked groups, secrets and packing together: see tests/llm.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised."""
    return language_id.accepted(docs, language_id.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark out of the texts."""
    return _counted(decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, and weak candidates that belong to a credential."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of tokens."""
    return packing.pack(packing.cut_pieces(docs, packing.tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("secrets", remove_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
