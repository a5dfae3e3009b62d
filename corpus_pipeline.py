"""A training-data pipeline over ``documents``: each stage applies one operator of ``tidebars.llm`` to what is left.

All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebars.llm import jaccard, language, mixing, packing, pii
from tidebars.llm.common import table
from tidebars.llm.queries import set_up, tokenizer_paths
from tidebars.session import stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, or without a letter; a missing language is filled in."""
    set_up(spark)
    return language.known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, similarity 0.8."""
    set_up(spark)
    return jaccard.keep_one(docs, 5, 80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    set_up(spark)
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: never, once or twice."""
    set_up(spark)
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_up(spark)
    return packing.pack(docs, *tokenizer_paths())


STAGES = [("language", languages), ("jaccard", near_copies), ("pii", private), ("mixing", mix), ("packing", pack)]

#: Trained models, hashed draws and token ids are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
