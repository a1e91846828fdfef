"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliate.llm import decontamination, mixing, pii, simhash, toxicity
from foliate.llm.shared import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, pii.key_of(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("personal_data", personal_data),
    ("mixing", mixture),
]
#: Toxicity, near-duplicates, decontamination and surrogates are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that every stage keeps, with the columns of documents; each stage's table is written in the shared folder.

    A stage treats null and empty texts, null ids, repeated rows and very long texts as its operator says: null and empty
    texts pass the first four stages and null ids are left out by mixing. Extra columns stay as they are, whatever their
    names; an empty table stays empty. Surrogates are those of the session's key, or else of a key of this run.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
