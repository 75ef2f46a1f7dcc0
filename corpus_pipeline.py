"""A training corpus from raw documents: each stage reads what the one before it kept.

Every stage decides row by row or for a row's text, so rows without an id or with a shared one
are documents like others. All but the last return the columns of documents as they came, columns
that a caller has added included; the last adds words, weight and copies.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.decontaminate import without_leaks
from kinfold.llm.minhash import deduplicate
from kinfold.llm.mixing import mix
from kinfold.llm.pii import pseudonymise
from kinfold.llm.queries import pii_key
from kinfold.llm.scratch import Scratch
from kinfold.llm.toxicity import reject_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words to a shingle, similarity of 0.8 or more."""
    return deduplicate(docs, words_each=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, pii_key(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with how often: copies; and their source's weight."""
    return mix(docs)


def lean(stage):
    """The stage, begun after the driver has given back what the ones before left there."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        Scratch(spark, "pipeline").release()
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(stage.__name__, lean(stage)) for stage in (toxicity, near_dedup, decontamination, pii, mixing)]
#: SQL can express neither the classifier nor the MinHash tables; tests/llm checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
