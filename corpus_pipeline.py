"""From documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one
begins, so that a lost executor or driver costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from habitus.llm import decontamination, packing, pii, simhash, toxicity
from habitus.llm.queries import table, vocabulary
from habitus.llm.store import store


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic.

    The chain is fitted on the labelled ones among ``docs``.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, null last.

    Groups are formed by the texts of rows, whatever doc_id they repeat or lack.
    """
    return simhash.deduplicated(docs, length=3, most=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with their ids."""
    return packing.pack(docs, vocabulary(), ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Neither the fitted chain nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
