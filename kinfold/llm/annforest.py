"""Nearest neighbours by inner product from a hash-prefix forest.

Every vector gets, in each of TREES trees, a string of BITS signs of projections on random
directions. A tree is a sorted array of those strings; what shares a prefix with a query is a
range of it. A query descends to its longest matches and then goes up, one bit at a time in
every tree in turn, until the ranges hold `quota` entries for each indexed vector; the vectors
in them, and no others, are scored.

The index is cut into blocks by hash of the id, each with a forest of its own, which is built
once and written: for each vector its strings and its places in the sorted arrays. A task holds
the forest of one block and reads the queries past it in batches, so its memory is bounded, the
index is never copied, and a query is sent once to each block; the best of all blocks are
merged. Scores are first taken in single precision; what could be among the best after rounding
is scored again in double precision from the vectors as they are.

The quota is fitted for each length of vectors: the least of a grid that finds `target` of the
true neighbours of a bounded sample (at most SAMPLE vectors, as many as a block has, of which
PROBES are queries; those of least hash). Of a query's k neighbours a block has the share that
falls to it, so that many are looked for in the sample. On vectors without structure that is a good part of a
block: prefixes tell little about them. `candidates` in the result says how many vectors of the
neighbour's block were scored for the query.

Null or zero vectors and those holding null or non-finite components take no part. Vectors of
different length aren't compared. Rows that repeat an id are one vector (the least, as arrays
compare). Ties go to the smaller id. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.scratch import Scratch

TREES, BITS = 64, 32
BLOCK = 8192
SAMPLE, PROBES = BLOCK, 256
QUOTAS = tuple(0.02 * 1.15**k for k in range(60))


@functools.lru_cache(8)
def _directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, TREES * BITS))


def strings(x: np.ndarray) -> np.ndarray:
    """(n, TREES) strings of BITS signs as unsigned numbers."""
    out = np.empty((len(x), TREES), np.uint32)
    for k in range(0, len(x), 1024):
        signs = (x[k : k + 1024] @ _directions(x.shape[1]) > 0).reshape(-1, TREES, BITS)
        out[k : k + 1024] = np.packbits(signs, axis=2).view(">u4")[..., 0]
    return out


def places(h: np.ndarray) -> np.ndarray:
    """Where each string stands in its tree's sorted array; (n, TREES)."""
    out, order = np.empty(h.shape, np.int32), np.argsort(h, axis=0, kind="stable")
    np.put_along_axis(out, order, np.arange(len(h), dtype=np.int32)[:, None], 0)
    return out


class Forest:
    """Sorted arrays of strings (TREES, n), and which vector each entry is."""

    def __init__(self, h: np.ndarray, place: np.ndarray):
        self.n = len(h)
        self.sorted, self.entry = np.empty((TREES, self.n), np.uint64), np.empty((TREES, self.n), np.int32)
        for t in range(TREES):
            self.sorted[t, place[:, t]] = h[:, t]
            self.entry[t, place[:, t]] = np.arange(self.n)

    def ranges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(BITS + 1, queries, TREES) beginnings and ends of what shares a prefix of each length."""
        low, high = np.empty((2, BITS + 1, len(h), TREES), np.int32)
        for depth in range(BITS + 1):
            rest = np.uint64(BITS - depth)
            first = h.astype(np.uint64) >> rest << rest
            last = first + (np.uint64(1) << rest)
            for t in range(TREES):
                low[depth, :, t] = np.searchsorted(self.sorted[t], first[:, t])
                high[depth, :, t] = np.searchsorted(self.sorted[t], last[:, t])
        return low, high

    def candidates(self, h: np.ndarray, quotas: tuple[float, ...], least: int) -> Iterator[list[np.ndarray]]:
        """For each query and quota the vectors in the first ranges that hold enough entries, `least` vectors or all at any rate."""
        low, high = self.ranges(h)
        size = (high - low).astype(np.int64)
        gain = np.concatenate([size[BITS:], size[:-1][::-1] - size[1:][::-1]])  # by depth, from the longest prefix up
        held = np.cumsum(gain.transpose(1, 0, 2).reshape(len(h), -1), axis=1)
        seen = np.zeros(self.n, bool)

        def held_by(q: int, entries: float) -> np.ndarray:
            last = min(np.searchsorted(held[q], min(entries, TREES * self.n)), held.shape[1] - 1)
            level, tree = divmod(int(last), TREES)
            seen[:] = False
            for t in range(TREES if level else tree + 1):
                depth = BITS - level + (t > tree)
                seen[self.entry[t, low[depth, q, t] : high[depth, q, t]]] = True
            return np.flatnonzero(seen)

        for q in range(len(h)):
            found = [held_by(q, quota * self.n) for quota in quotas]
            yield [f if len(f) >= least else held_by(q, TREES * least) for f in found]


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(dtype, copy=False)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    h = strings(np.stack(rows["v"]).astype(np.float64))
    return pd.DataFrame({"dim": rows["dim"], "block": rows["block"], "vec_id": rows["vec_id"], "v": rows["v"], "h": list(h.astype(np.int64)), "place": list(places(h))})


def _best(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the k highest, and of what is within the slack of the last."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack)


class _Block:
    """A block of the index in one task."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, h: np.ndarray, place: np.ndarray):
        self.ids, self.x, self.forest = ids, x, Forest(h, place)
        self.single, self.longest = x.astype(np.float32), np.sqrt((x * x).sum(1).max())

    def search(self, ids: np.ndarray, x: np.ndarray, h: np.ndarray, k: int, quota: float) -> Iterator[tuple]:
        """(query_id, vec_id, score, candidates) arrays for each query, best first."""
        for i, (found,) in enumerate(self.forest.candidates(h, (quota,), k + 1)):
            found = found[self.ids[found] != ids[i]]
            if not len(found):
                continue
            q = x[i]
            size = np.sqrt(q @ q) * self.longest
            if size < 1e30:
                slack = 4e-7 * (len(q) + 8) * size
                near = found[_best(self.single[found] @ q.astype(np.float32), k, slack)]
            else:  # beyond single precision
                near = found
            exact = (self.x[near] * q).sum(1)
            order = np.lexsort((self.ids[near], -exact))[:k]
            yield np.full(len(order), ids[i]), self.ids[near[order]], exact[order], np.full(len(order), len(found))


def _search(batches: Iterator[pa.RecordBatch], k: int, quotas: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (dim, block, is query): the index entries of a block, then the queries."""
    now, held, forest = None, [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), len(batch)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            dim, block, is_query = (int(x) for x in key[:, lo])
            if (dim, block) != now:
                now, held, forest = (dim, block), [], None
            part = batch.slice(lo, hi - lo)
            ids, x, h = part.column(3).to_numpy(), _matrix(part.column(4), np.float64), _matrix(part.column(5), np.int64).astype(np.uint32)
            if not is_query:
                held.append((ids, x, h, _matrix(part.column(6), np.int32)))
                continue
            if forest is None and held:
                forest, held = _Block(*map(np.concatenate, zip(*held, strict=True))), []
            if forest is None:
                continue
            for at in range(0, len(ids), 256):
                rows = slice(at, at + 256)
                if found := list(forest.search(ids[rows], x[rows], h[rows], k, quotas[dim])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score", "candidates"])


def calibrate(x: np.ndarray, n: int, k: int, target: float) -> float:
    """The least quota that finds `target` of the k nearest others among x for the first n of them."""
    if len(x) <= 1:
        return float(TREES)
    h = strings(x)
    forest, scores = Forest(h, places(h)), x[:n] @ x.T
    scores[np.arange(len(scores)), np.arange(len(scores))] = -np.inf
    k = min(k, len(x) - 1)
    truth = scores >= np.partition(scores, len(x) - k, axis=1)[:, len(x) - k][:, None]

    def enough(quota: float) -> bool:
        found = forest.candidates(h[:n], (quota,), k + 1)
        return sum(truth[q][f].sum() for q, (f,) in enumerate(found)) >= target * truth.sum()

    at = bisect.bisect_left(QUOTAS, True, key=enough)  # recall grows with the quota
    return QUOTAS[at] if at < len(QUOTAS) else float(TREES)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, target: float = 0.95, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, candidates: for each vector that is_query holds for (by vec_id), its k nearest others."""
    scratch = Scratch(vectors.sparkSession, "annforest")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = scratch.save(rows.where(usable).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    place, quotas, blocks = F.xxhash64("vec_id"), {}, {}
    for dim, n in rows.groupBy("dim").agg(F.count(F.lit(1))).collect():  # one row for most tables
        blocks[dim] = -(-n // block)
        wanted, bits = min(SAMPLE, -(-n // blocks[dim])), 1 << 30
        few = rows.where(F.col("dim") == dim).where(F.pmod(place, F.lit(bits)) < int(bits * min(1.0, (1.2 * wanted + 500) / n)))
        sample = few.orderBy(F.pmod(place, F.lit(bits)), "vec_id").limit(wanted).collect()
        quotas[dim] = calibrate(np.array([r.v for r in sample]), PROBES, -(-k // blocks[dim]), target)
    if not blocks:
        return rows.selectExpr("vec_id query_id", "0 rank", "vec_id", "0D score", "0L candidates")
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("dim"))
    dealt = rows.withColumn("block", F.pmod(place, n_blocks).cast("int"))
    index = scratch.save(dealt.groupBy("dim", "block").applyInPandas(_build, "dim int, block int, vec_id long, v array<double>, h array<long>, place array<int>"))
    asked = index.where(is_query).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn("place", F.lit(None).cast("array<int>"))
    both = index.withColumn("is_query", F.lit(0)).unionByName(asked.withColumn("is_query", F.lit(1)))
    both = both.select("dim", "block", "is_query", "vec_id", "v", "h", "place").repartition("dim", "block").sortWithinPartitions("dim", "block", "is_query", "vec_id")
    found = both.mapInArrow(functools.partial(_search, k=k, quotas=quotas), "query_id long, vec_id long, score double, candidates long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "candidates")
