"""Ranks, gaps and competitors of scored pairs. Missing scores rank last; ties go to the lesser key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.tables import written

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def context(pairs: DataFrame, score: str, prefix: str) -> DataFrame:
    """Rank, gap to the best and count among an S1's records and among a record's S1s, and margin to the record's second. Two shuffles, whatever the number of columns."""
    by_s1 = Window.partitionBy("s1").orderBy(F.desc_nulls_last(score), "rec")
    by_rec = Window.partitionBy("rec").orderBy(F.desc_nulls_last(score), "s1")
    out = pairs.withColumns({f"{prefix}_rank1": F.row_number().over(by_s1), f"{prefix}_gap1": F.max(score).over(by_s1.rowsBetween(*ALL)) - F.col(score), f"{prefix}_n1": F.count(F.lit(1)).over(by_s1.rowsBetween(*ALL))})
    second = F.nth_value(score, 2).over(by_rec.rowsBetween(*ALL))
    return out.withColumns(
        {f"{prefix}_rank2": F.row_number().over(by_rec), f"{prefix}_gap2": F.max(score).over(by_rec.rowsBetween(*ALL)) - F.col(score), f"{prefix}_n2": F.count(F.lit(1)).over(by_rec.rowsBetween(*ALL)), f"{prefix}_margin2": F.col(score) - second}
    )


def competitor(pairs: DataFrame, score: str = "p") -> DataFrame:
    """comp: the best score of the record's other S1s (0 if none); is_arg: whether this pair has the record's best."""
    w = Window.partitionBy("rec").orderBy(F.desc_nulls_last(score), "s1").rowsBetween(*ALL)
    best, second = F.max(score).over(w), F.nth_value(score, 2).over(w)
    out = pairs.withColumns({"_best": best, "_second": F.coalesce(second, F.lit(0.0))})
    arg = F.col(score) == F.col("_best")
    return out.withColumn("comp", F.when(arg, F.col("_second")).otherwise(F.col("_best"))).withColumn("is_arg", arg).withColumn("margin", F.col(score) - F.col("comp")).drop("_best", "_second")


def ranks(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """df with _rank (from 1) by the order, which should be total, among the _n rows that agree in `by`.

    A hot key is dealt over many tasks: rows are split by range, ranked within their range, and
    moved on by the sizes of the ranges before. Those sizes, a row for each range and key in it,
    are the only thing broadcast.
    """
    dealt = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    within = Window.partitionBy(*by)
    sizes = sizes.withColumns({"_before": F.sum("_size").over(within.orderBy("_range")) - F.col("_size"), "_n": F.sum("_size").over(within)}).drop("_size")
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(sizes), [*by, "_range"]).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
