"""From documents to token files, stage by stage; each stage takes all that the one before it kept.

Toxic documents go; one document of each near-duplicate group stays, that with the smallest doc_id; documents with a
benchmark window in them go; the rest is mixed to source targets, a document as often as the mix takes it; and the ids of
what is left are written to files and read back. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, mixing, simhash, tokens, toxicity
from folioflow.llm.queries import table, tokenizer_path
from folioflow.llm.store import keep, prepare


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_files(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokenized),
]

#: A tokenizer can't be expressed in SQL; the tests hold the stages to plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents of a folder; each result is written and read again by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
