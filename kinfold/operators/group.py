"""Features of a pair within the group of its S1's strong records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.similarity import kernel
from kinfold.operators.features import words
from kinfold.operators.retrieval import Encode, dot, text_cosine
from kinfold.operators.windows import competitor

STRONG = 0.5


def group_features(pred: DataFrame, norm: DataFrame, vectors: DataFrame | None = None, encode: Encode | None = None) -> DataFrame:
    """s1, rec and g_*: competition for the record, the S1's total, and agreement with its other strong records (missing values don't count). Cosines are those of vectors, or of what encode makes of the records' texts: these are less to join."""
    own = competitor(pred.select("s1", "rec", "p"))
    strong = (F.col("p") >= STRONG) & F.col("is_arg")
    whole = Window.partitionBy("s1")
    base = own.withColumns({"g_sum": F.sum("p").over(whole), "g_strong": F.count_if(strong).over(whole), "g_rank": F.row_number().over(whole.orderBy(F.desc("p"), "rec")), "g_n2": F.count(F.lit(1)).over(Window.partitionBy("rec"))})
    others = own.where(strong).select("s1", F.col("rec").alias("j"))
    fields = ["name_n", "core", "addr_n", "nums"]
    side = lambda key, s: norm.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in fields])
    pairs = own.select("s1", "rec").join(others, "s1").where("rec <> j").join(side("rec", "r"), "rec").join(side("j", "j"), "j")
    if vectors is not None:
        pairs = pairs.join(vectors.select(F.col("id").alias("rec"), F.col("v").alias("vr")), "rec", "left").join(vectors.select(F.col("id").alias("j"), F.col("v").alias("vj")), "j", "left").withColumn("cos", dot(F.col("vr"), F.col("vj")))
    elif encode is not None:
        pairs = pairs.withColumn("cos", text_cosine(encode)(*[F.concat_ws(" | ", f"name_n_{s}", f"addr_n_{s}") for s in ("r", "j")]))
    else:
        pairs = pairs.withColumn("cos", F.lit(None).cast("double"))
    addr = F.when((F.col("addr_n_r") != "") & (F.col("addr_n_j") != ""), kernel("token_set_ratio")("addr_n_r", "addr_n_j"))
    shared = F.when(F.size(words(F.col("nums_r"))) > 0, F.arrays_overlap(words(F.col("nums_r")), words(F.col("nums_j"))).cast("double"))
    pairs = pairs.withColumns({"ts": kernel("token_sort_ratio")("name_n_r", "name_n_j"), "cs": kernel("token_set_ratio")("core_r", "core_j"), "ad": addr, "nu": shared})
    sums = pairs.groupBy("s1", "rec").agg(
        *[f(c).alias(f"g_{c}_{n}") for c in ("cos", "ts", "cs", "ad") for f, n in ((F.max, "max"), (F.avg, "mean"))], F.avg("nu").alias("g_num_share"), F.count(F.lit(1)).alias("g_others")
    )
    return base.select("s1", "rec", F.col("comp").alias("g_comp"), F.col("margin").alias("g_margin"), "g_sum", "g_strong", "g_rank", "g_n2").join(sums, ["s1", "rec"], "left").na.fill(0, ["g_others"]).join(number_support(pred, norm), ["s1", "rec"], "left")


def number_support(pred: DataFrame, norm: DataFrame) -> DataFrame:
    """s1, rec, g_s1_support: of the S1's own numbers, the share that the record has."""
    num = norm.select("entity_id", F.array_distinct(words(F.col("nums"))).alias("w"))
    both = pred.select("s1", "rec").join(num.toDF("s1", "wa"), "s1").join(num.toDF("rec", "wb"), "rec")
    return both.select("s1", "rec", F.try_divide(F.size(F.array_intersect("wa", "wb")).cast("double"), F.size("wa").cast("double")).alias("g_s1_support"))
