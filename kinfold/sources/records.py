"""Record sources and sinks: tab-separated files, truth lists, results, artifacts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = ("entity_id", "business_name", "business_address", "country")


@dataclass(frozen=True)
class Config:
    """Where a run reads and writes, and its seed."""

    data: str = field(default_factory=lambda: os.environ.get("KINFOLD_DATA", "data"))
    artifacts: str = field(default_factory=lambda: os.environ.get("KINFOLD_ARTIFACTS", "artifacts"))
    seed: int = field(default_factory=lambda: int(os.environ.get("KINFOLD_SEED", "0")))


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW) -> DataFrame:
    """All strings, no quoting, missing fields empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", enforceSchema=False).csv(path).na.fill("")


def load_records(spark: SparkSession, data: str, split: str) -> DataFrame:
    """entity_id, src, name, addr, country of the three sources."""
    out = None
    for s in (1, 2, 3):
        one = read_tsv(spark, f"{data}/{split}_source{s}.tsv").select("entity_id", F.lit(s).cast("tinyint").alias("src"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")
        out = one if out is None else out.unionByName(one)
    return out


def check_records(records: DataFrame) -> DataFrame:
    """Per source: rows, repeated ids, ids without the source's prefix, nulls. One aggregation by id, one by source."""
    by_id = records.groupBy("src", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").isNull() | F.col("addr").isNull() | F.col("country").isNull()).alias("nulls"))
    bad = ~F.startswith(F.col("entity_id"), F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-")))
    return by_id.groupBy("src").agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum(F.when(bad | F.col("entity_id").isNull(), F.col("n")).otherwise(0)).alias("n_bad_prefix"), F.sum("nulls").alias("n_null")
    )


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1, rec) from lists of matches."""
    return truth.where("matched_entity_ids <> ''").select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("rec"))


def match_counts(truth: DataFrame) -> DataFrame:
    n = F.when(F.col("matched_entity_ids") == "", 0).otherwise(F.size(F.split("matched_entity_ids", ",")))
    return truth.select(F.col("source1_entity_id").alias("s1"), n.alias("n_match"))


def missing_truth_records(truth: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs whose record isn't in sources 2 and 3."""
    return truth.join(records.where("src > 1").select(F.col("entity_id").alias("rec")), "rec", "left_anti")


def result_lists(pairs: DataFrame, s1: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Every S1 with its records as a sorted comma list, empty if none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("rec")), ",").alias(column))
    return s1.select("s1").distinct().join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def read_result(spark: SparkSession, path: str, column: str = "matched_entity_ids") -> DataFrame:
    return truth_pairs(read_tsv(spark, path, ("source1_entity_id", column)).withColumnRenamed(column, "matched_entity_ids"))


def memo(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, built and written first unless it is complete."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_json(spark: SparkSession, value, path: str) -> None:
    """A small artifact in any store that Spark writes."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
