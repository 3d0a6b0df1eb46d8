"""Training-corpus pipeline: language, quality, near duplicates, benchmark leaks, tokens.

Each stage works on all rows that the stage before has kept; run() writes each stage's rows as
Parquet in the shared scratch folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.llm import decontaminate, language_id, ngram_join, quality_fm, scratch, sentencepiece_merge

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a recognisable language: null, empty or without letters."""
    return language_id.known(docs.select(COLUMNS), language_id.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the classifier, fitted on the labelled rows, scores under 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.good(docs.select(COLUMNS), quality_fm.train(docs, labels), least=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every group of linked documents."""
    return ngram_join.one_each(docs.select(COLUMNS), "doc_id", "text", k=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window like a benchmark item."""
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.75, k=5)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id), and the hash of the decoded text."""
    got = sentencepiece_merge.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
