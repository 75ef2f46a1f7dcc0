"""Keyed selections that don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.windows import ranks


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows by the md5 of key and seed: the same ones on every run and engine."""
    marked = df.withColumn("_mark", F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))))
    return ranks(marked, [], "_mark", *keys).where(F.col("_rank") <= n).select(df.columns)


def top_list(df: DataFrame, key: str, value: str, order: Column, n: int, name: str) -> DataFrame:
    """The first n values of each key, as a list in order."""
    w = Window.partitionBy(key).orderBy(order, value)
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value])
    return top.groupBy(key).agg(listed.alias(name))


def full_join_views(views: dict[str, DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join of k tables on their keys with one shuffle: tagged union and conditional aggregates."""
    tagged = None
    for tag, df in views.items():
        one = df.select(*keys, *columns, F.lit(tag).alias("_view"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*keys).agg(*[F.min(F.when(F.col("_view") == tag, F.col(c))).alias(f"{c}_{tag}") for tag in views for c in columns])


def cap_keys(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Rows whose key occurs at most cap times; counting aggregates before it shuffles, so a hot key costs nothing."""
    few = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap).drop("_n")
    return df.join(few, keys, "left_semi")
