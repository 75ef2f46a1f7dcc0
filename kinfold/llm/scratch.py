"""Lineage cuts: intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="kinfold-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def trim_native(spark: SparkSession) -> bool:
    """Return freed memory outside the driver's heap to the system; False where its JVM has no such command.

    Compiler and job threads allocate in malloc arenas of their own, which keep what was freed. Over
    many jobs they hold some hundreds of megabytes.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, *items):
        out = array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    none = filled(jvm.java.lang.Object), filled(jvm.java.lang.String)
    try:
        # by the public interface: the server's own class is closed to reflection
        named = jvm.java.lang.Class.forName
        kinds = "javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"
        invoke = named("javax.management.MBeanServer").getMethod("invoke", filled(jvm.java.lang.Class, *map(named, kinds)))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), filled(jvm.java.lang.Object, command, "systemTrimNativeHeap", *none))
    except Py4JError:
        return False
    return True


class Scratch:
    """Parquet tables under the shared checkpoint folder; a lost executor costs no recomputation beyond them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/kinfold-{label}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Give back what the driver no longer needs: objects, shuffle files of plans that nothing refers to, and memory outside the heap."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim_native(self.spark)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
