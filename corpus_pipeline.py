"""A corpus pipeline of five stages over documents; see STAGES. Part of the subpackage sievework.llm.

What a stage does with nulls in any column, empty and very long texts, repeated rows and ties is said at the operator it calls. In short: rows with a null doc_id and
null or empty texts pass the first four stages and give no tokens, except that a text cut to nothing goes; of rows that are repeated the copies share their fate; an empty table
passes all stages and gives an empty result; further columns are carried to the last stage, which doesn't read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import read, shared_folder
from sievework.llm.decontam import drop_contaminated
from sievework.llm.mixing import mix_sources
from sievework.llm.near_dup import keep_one
from sievework.llm.passages import cut_passages
from sievework.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on labels and this stage's documents, doesn't reject."""
    return reject_toxic(spark, docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies, and all others."""
    return keep_one(spark, docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; documents stay unless nothing is left."""
    return cut_passages(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of words with a benchmark item."""
    return drop_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of the documents, drawn to equal weights of the sources."""
    return mix_sources(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", shared_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The fitted model and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
