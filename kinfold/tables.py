"""Tables between steps: a short plan for what follows, and nothing to compute again if an executor is lost."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which a cluster shares; a local one, removed at exit, only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        folder = tempfile.mkdtemp(prefix="kinfold-tables-")
        atexit.register(shutil.rmtree, folder, True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once into the shared folder and read from there."""
    path = f"{shared_root(df.sparkSession)}/kinfold-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
