"""A training corpus from raw documents: five stages, each one operator of ``arborspark.llm``.

Every stage reads what its predecessor kept, written as Parquet in the shared folder, and decides on all of it. All but the
last return the columns of ``documents``; the last returns one row per copy that the mix takes, in training order.

Nulls, empty tables, repeated rows and ties are as each operator defines them; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm import decontamination, mixing, pii, quality, simhash
from arborspark.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker rejects go."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.train_on(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return pii.pseudonymize_column(docs, pii.key_of(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, with epoch, taken_words and position, sorted by position."""
    return mixing.curriculum(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("hide_personal_data", hide_personal_data),
    ("mix_sources", mix_sources),
]

#: SQL cannot express these stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
