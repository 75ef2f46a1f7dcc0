"""From pair probabilities to match sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.relational import keep_first

TOP = 16


def one_to_one(pairs: DataFrame, score: str = "p") -> DataFrame:
    """For each record its best S1; ties to the lesser key."""
    return keep_first(pairs, ["rec"], F.desc_nulls_last(score), F.col("s1"))


def pick_threshold(pairs: DataFrame, t: float, score: str = "q") -> DataFrame:
    return pairs.where(F.col(score) >= t)


def expected_sizes(pairs: DataFrame, bias: float = 0.0, score: str = "q") -> DataFrame:
    """s1, k: how many of an S1's best records maximise the approximate expected F0.5 (to 12 places, the fewest of equals); none if the chance that none is true is as good."""
    ordered = Window.partitionBy("s1").orderBy(F.desc(score), "rec")
    upto, whole = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.row_number().over(ordered)
    w = pairs.withColumns({"_k": k, "_ef": 1.25 * F.sum(score).over(upto) / (k + 0.25 * F.sum(score).over(whole))})
    best = w.groupBy("s1").agg(F.max_by("_k", F.struct(F.round("_ef", 12), -F.col("_k"))).alias("k"), F.max("_ef").alias("ef"), F.product(1 - F.col(score)).alias("none"))
    return best.select("s1", F.when(F.col("none") + bias >= F.col("ef"), 0).otherwise(F.col("k")).alias("k"))


def _keep_top(pairs: DataFrame, sizes: DataFrame, score: str) -> DataFrame:
    ordered = Window.partitionBy("s1").orderBy(F.desc(score), "rec")
    return pairs.withColumn("_k", F.row_number().over(ordered)).join(sizes, "s1").where("_k <= k").drop("_k", "k")


def pick_expected(pairs: DataFrame, bias: float = 0.0, score: str = "q") -> DataFrame:
    return _keep_top(pairs, expected_sizes(pairs, bias, score), score)


def expected_f05(q: np.ndarray) -> np.ndarray:
    """E[F0.5] of predicting the k best of rows of descending probabilities, k from 0, exactly, for independent outcomes."""
    m, n = q.shape
    head = np.zeros((n + 1, m, n + 1))
    tail = np.zeros((n + 1, m, n + 1))
    head[0, :, 0] = tail[n, :, 0] = 1
    for k in range(n):
        for to, of, p in ((head[k + 1], head[k], q[:, k]), (tail[n - 1 - k], tail[n - k], q[:, n - 1 - k])):
            to[:] = of * (1 - p)[:, None]
            to[:, 1:] += of[:, :-1] * p[:, None]
    a, b = np.arange(n + 1)[:, None], np.arange(n + 1)[None]
    out = np.empty((m, n + 1))
    out[:, 0] = tail[0][:, 0]
    for k in range(1, n + 1):
        value = 1.25 * a / (k + 0.25 * (a + b))
        out[:, k] = ((head[k] @ value) * tail[k]).sum(1)
    return out


def exact_sizes(pairs: DataFrame, bias: float = 0.0, score: str = "q") -> DataFrame:
    """s1, k by the exact expectation over an S1's TOP best records; a batch of S1s is one array."""

    def sizes(lists: pd.Series) -> pd.Series:
        q = np.zeros((len(lists), TOP))
        for i, x in enumerate(lists):
            q[i, : len(x)] = x
        value = expected_f05(q)
        value[:, 0] += bias
        value[np.arange(TOP + 1)[None] > (q > 0).sum(1)[:, None]] = -1
        value = np.round(value, 12)
        return pd.Series(value.argmax(1).astype(np.int32))

    sizes.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    ordered = Window.partitionBy("s1").orderBy(F.desc(score), "rec")
    top = pairs.withColumn("_k", F.row_number().over(ordered)).where(F.col("_k") <= TOP).groupBy("s1").agg(F.sort_array(F.collect_list(F.col(score)), asc=False).alias("qs"))
    return top.select("s1", F.pandas_udf(sizes, "int")("qs").alias("k"))


def pick_expected_exact(pairs: DataFrame, bias: float = 0.0, score: str = "q") -> DataFrame:
    return _keep_top(pairs, exact_sizes(pairs, bias, score), score)


THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BIASES = (-0.2, -0.1, 0.0, 0.1, 0.2)


def threshold_grid(pairs: DataFrame, truth: DataFrame, s1: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Macro F0.5 at each threshold, in one pass over the pairs."""
    marked = pairs.join(truth.withColumn("y1", F.lit(1)), ["s1", "rec"], "left").select("s1", "q", F.coalesce("y1", F.lit(0)).alias("hit"), F.explode(F.array(*map(F.lit, thresholds))).alias("t")).where("q >= t")
    counts = marked.groupBy("s1", "t").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("hit").alias("tp"))
    n_true = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    every = s1.select("s1", F.explode(F.array(*map(F.lit, thresholds))).alias("t")).join(n_true, "s1", "left").join(counts, ["s1", "t"], "left").na.fill(0)
    from kinfold.operators.evaluate import f05

    return every.groupBy("t").agg(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("macro_f05"))


def best_policy(pairs: DataFrame, truth: DataFrame, s1: DataFrame) -> tuple[str, float, float]:
    """(policy, parameter, macro F0.5): thresholds, then approximate, then exact biases; the first of equals."""
    from kinfold.operators.evaluate import per_entity

    pairs = pairs.persist()
    tried = [("threshold", r.t, r.macro_f05) for r in sorted(threshold_grid(pairs, truth, s1).collect(), key=lambda r: r.t)]
    for name, pick in (("expected", pick_expected), ("exact", pick_expected_exact)):
        for bias in BIASES:
            tried.append((name, bias, per_entity(pick(pairs, bias), truth, s1).agg(F.avg("f05")).first()[0]))
    pairs.unpersist()
    best = tried[0]
    for x in tried[1:]:
        best = x if x[2] > best[2] else best
    return best


def logit(p):
    return F.ln(p / (1 - p))


def shifted(q, offset: float):
    """q moved by an offset of its log odds."""
    p = F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(logit(p) + offset)))


def label_shift(pairs: DataFrame, target: float, n_s1: int, threshold: float = 0.5, steps: int = 12, tolerance: float = 0.002, most: float = 6.0) -> float:
    """The offset in [0, most] under which matches per S1 come to the target: a bisection over the counts of a grid of 2**steps offsets, taken in one pass."""
    cells, q = 2**steps, F.least(F.greatest(F.col("q"), F.lit(1e-6)), F.lit(1 - 1e-6))
    beyond = F.floor((logit(q) - logit(F.lit(threshold))) * cells / most + 1e-9)
    counts = np.zeros(cells + 1)
    for r in pairs.groupBy(F.greatest(F.lit(-1), F.least(F.lit(cells), beyond)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        if r.cell is not None and r.cell >= 0:
            counts[r.cell] = r.n
    left = counts[::-1].cumsum()[::-1]
    low, high, mid = 0.0, most, 0.0
    for _ in range(steps):
        mid = (low + high) / 2
        n = left[round(mid * cells / most)] / max(n_s1, 1)
        if abs(n - target) < tolerance:
            break
        low, high = (mid, high) if n > target else (low, mid)
    return mid


def summary(pred: DataFrame, candidates: DataFrame, s1: DataFrame) -> DataFrame:
    """Per country: predictions per S1, share of S1s without any, candidates per S1."""
    n = pred.groupBy("s1").agg(F.count(F.lit(1)).alias("np"))
    c = candidates.groupBy("s1").agg(F.count(F.lit(1)).alias("nc"))
    each = s1.join(n, "s1", "left").join(c, "s1", "left").na.fill(0, ["np", "nc"])
    return each.groupBy("country").agg(F.avg("np").alias("pred_per_s1"), F.avg((F.col("np") == 0).cast("double")).alias("empty_share"), F.avg("nc").alias("cand_per_s1"))
