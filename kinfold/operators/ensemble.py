"""Runs combined: mean log odds, and outputs spliced by country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING, EDGE = 1e-4, 1e-6


def ensemble_logits(runs: list[DataFrame]) -> DataFrame:
    """s1, rec, p: the sigmoid of the runs' mean log odds; a pair that a run lacks counts as MISSING. One shuffle."""
    tagged = None
    for k, run in enumerate(runs):
        one = run.select("s1", "rec", "p", F.lit(k).alias("run"))
        tagged = one if tagged is None else tagged.unionByName(one)
    each = [F.coalesce(F.max(F.when(F.col("run") == k, F.col("p"))), F.lit(MISSING)) for k in range(len(runs))]
    odds = [F.ln(F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE)) / (1 - F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE)))) for p in each]
    mean = sum(odds[1:], odds[0]) / len(runs)
    return tagged.groupBy("s1", "rec").agg((1 / (1 + F.exp(-mean))).alias("p"))


def union_candidates(runs: list[DataFrame]) -> DataFrame:
    out = runs[0].select("s1", "rec")
    for run in runs[1:]:
        out = out.union(run.select("s1", "rec"))
    return out.distinct()


def splice(s1: DataFrame, labelled: list[str], a: DataFrame, b: DataFrame, b2: DataFrame | None = None, mode: str = "single") -> DataFrame:
    """Pairs of a for S1s of labelled countries; for the others those of b, or what b and b2 share, or either has."""
    other = b.select("s1", "rec")
    if mode != "single":
        other = other.intersect(b2.select("s1", "rec")) if mode == "intersect" else other.union(b2.select("s1", "rec")).distinct()
    known = s1.select("s1", F.col("country").isin(labelled).alias("lab"))
    both = a.select("s1", "rec", F.lit(True).alias("lab")).union(other.select("s1", "rec", F.lit(False)))
    return both.join(known, ["s1", "lab"]).select("s1", "rec").distinct()
