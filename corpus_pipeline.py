"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Part of the training-data package; needs `ledgerloom.llm`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import bpe_digests, vocabulary
from ledgerloom.llm.common import table, written
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.near_dedup import near_dedup
from ledgerloom.llm.toxicity import detoxify


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go; learnt from the labels outside the held-out third."""
    return detoxify(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least id stays."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, for each document that is left."""
    return bpe_digests(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("bpe", tokens)]
#: SQL can't express the toxicity model or BPE; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
