"""Nearest neighbours: recall against brute force, exact scores, ties and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import annforest
from kinfold.llm.annforest import Forest, nearest


def brute(x, ids, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(1)
            out[i] = sorted((-v, j) for v, j in zip(s, ids) if j != i)[:k]
    return out


def test_ranges_hold_what_shares_the_prefix():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    h = annforest.strings(x)
    forest = Forest(h, annforest.places(h))
    assert (np.sort(h, axis=0).T == forest.sorted).all()
    same = h[:5, None, :] ^ h[None]
    for q, (found,) in enumerate(forest.candidates(h[:5], (0.5,), 1)):
        depth = np.array([[annforest.BITS - int(v).bit_length() for v in row] for row in same[q]])  # of the common prefix
        levels = [(d, t) for d in range(annforest.BITS, -1, -1) for t in range(annforest.TREES)]
        held = lambda d, t: (depth[:, : t + 1] >= d).sum() + (depth[:, t + 1 :] >= d + 1).sum()
        d, t = next((d, t) for d, t in levels if held(d, t) >= 150)
        want = (depth[:, : t + 1] >= d).any(1) | (depth[:, t + 1 :] >= d + 1).any(1)
        assert (np.flatnonzero(want) == found).all()


def tables(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(40, 16)).repeat(120, 0) + 0.25 * rng.normal(size=(4800, 16))
    yield spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 1.0
    yield spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(near)], "vec_id long, embedding array<double>, rank string"), 0.25


def test_recall(spark):
    """On vectors without structure, where many are scored, and on clustered ones, where few are."""
    for df, most in tables(spark):
        table = df.select("vec_id", "embedding").collect()
        x, ids = np.array([r.embedding for r in table], np.float64), [r.vec_id for r in table]
        truth, at = brute(x, ids, 20), dict(zip(ids, x))
        for block in (700, annforest.BLOCK):
            got, scored = {}, []
            for r in nearest(df, F.col("vec_id") % 20 == 0, block=block).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.vec_id)
                scored.append(r.candidates)
                assert abs(r.score - float((at[r.query_id] * at[r.vec_id]).sum())) < 1e-12 and r["rank"] == len(got[r.query_id])
            assert got.keys() == truth.keys() and all(len(v) == 20 for v in got.values())
            assert np.mean([len(set(got[q]) & {j for _, j in truth[q]}) / 20 for q in truth]) >= 0.9
            assert np.mean(scored) < most * min(block, len(x)) - (most == 1.0)


def test_odd_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (104, [None, 1.0]), (0, [1.0, 2.0]), (120, [3.0]), (121, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:4] for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    want = [(0, k, k, 5.0) for k in range(1, 21)] + [(20, k + 1, k, 5.0) for k in range(20)] + [(120, 1, 121, 3.0)]
    assert got == want
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
