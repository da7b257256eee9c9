"""The corpus pipeline: documents in, token shards out.

Every stage takes all rows that the one before it kept. The first three drop rows (toxic documents,
all but one of a group of near copies, documents with benchmark passages), the fourth repeats or
drops rows to reach the sources' targets, the last writes token shards and returns what reading
them back gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from renewlens.llm import op1_mixing, op5_token_shards, op6_simhash, op7_toxicity, op10_decontaminate
from renewlens.llm.common import table, workers_find_package
from renewlens.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_toxicity.drop_toxic(docs, op7_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return op6_simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return op1_mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return op5_token_shards.token_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

# learned scores, 64-bit SimHash and tokenization have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
