"""Connected components by alternating large and small stars; each round's edges lie in the shared folder.

Before each round every task replaces its own edges by a spanning forest of them, so what is
shuffled is bounded by the nodes that a task sees. Once no more than ONE_TASK edges are left,
one task unites them; a larger table goes on in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.scratch import Scratch

#: Edges that one task unites (16 bytes each), and of which a task makes one forest.
ONE_TASK, FOREST = 500_000, 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges in order, and the least node that each is connected with."""
    nodes, of = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = of[: len(u)], of[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jump := label[label]):
            label = jump
    return nodes, nodes[label]


def _star(u: np.ndarray, v: np.ndarray, whole: bool) -> pa.RecordBatch:
    node, least = forest(u, v)
    keep = slice(None) if whole else node != least
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], ["u", "v"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size >= FOREST:
            yield _star(*map(np.concatenate, zip(*held, strict=True)), whole=False)
            held, size = [], 0
    if held:
        yield _star(*map(np.concatenate, zip(*held, strict=True)), whole=False)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        yield _star(*map(np.concatenate, zip(*held, strict=True)), whole=True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) pairs to (node, component): the smallest node reachable, for each node that has a link."""
    edges = links.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now, seen = scratch.save(edges.mapInArrow(_forests, "u long, v long").distinct()), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark[0] <= one_task:
            return scratch.save(now.repartition(1).mapInArrow(_united, "u long, v long").toDF("node", "component"))
        if mark == seen:
            break
        stars = _small_star(_large_star(now.mapInArrow(_forests, "u long, v long")))
        after, seen = scratch.save(stars), mark
        scratch.drop(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
