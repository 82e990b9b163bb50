"""Corpus cleaning in five stages; each takes all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklens.llm import decontaminate, jaccard, langid, packing, quality
from tracklens.llm.common import batch_rows, fold, scratch, table

#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 500


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: some letter, and a prediction that isn't a guess."""
    batch_rows(spark, TEXT_ROWS)
    return langid.with_language(docs, fold(docs.doc_id, 5) == 0)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    batch_rows(spark, TEXT_ROWS)
    return quality.accepted(docs, table(spark, sf_dir, "labels"), fold(docs.doc_id, 5) == 0)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    batch_rows(spark, TEXT_ROWS)
    return jaccard.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    batch_rows(spark, TEXT_ROWS)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    batch_rows(spark, TEXT_ROWS)
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good), ("near copies", distinct), ("decontamination", clean), ("packing", packed)]

#: No stage is an SQL query: networks, discriminants and tokenizers aren't. Tests hold the operators of the stages against plain versions, and the stages' effects on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
