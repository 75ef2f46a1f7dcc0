"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> bytes:
    """The session's key for pseudonyms; without one these queries use a word that protects nothing, for synthetic tables."""
    return spark.conf.get("spark.kinfold.pii.key", "synthetic").encode()


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words_each=3, num=85, den=100)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.htmlmain import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), pii_key(spark), counted=True)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.lblm import held_out, score

    return score(_table(spark, sf_dir, "documents"), ~held_out())


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.langid import identify_held_out

    return identify_held_out(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.annforest import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "words", "weight", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_secrets": op2_secrets, "op3_lm": op3_lm, "op4_langid": op4_langid, "op5_ann": op5_ann, "op6_mixing": op6_mixing, "op7_toxicity": op7_toxicity, "op8_html": op8_html, "op9_decontaminate": op9_decontaminate, "op10_pii": op10_pii}


def oracle_sql() -> dict[str, str]:
    from kinfold.llm.decontaminate import leaks_sql
    from kinfold.llm.secrets import secrets_sql

    return {"op2_secrets": secrets_sql(), "op9_decontaminate": leaks_sql()}
