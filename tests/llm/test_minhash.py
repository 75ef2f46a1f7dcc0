"""Near duplicates against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from kinfold.llm.graph import components
from kinfold.llm.minhash import deduplicate, near_duplicates, overlaps
from kinfold.llm.scratch import Scratch


def brute(rows, size, num, den):
    sets, parent = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{k}É" if k % 7 == 0 else f"W{k}" for k in range(3000)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c"), (7, "x " * 30000)]
    n = 10
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "\n"]).join(w)))
            n += 1
    return rows


def test_against_all_pairs(spark):
    rows = copies()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, digest string, half int")
    for size, num in ((3, 85), (5, 80)):
        got = {tuple(r) for r in near_duplicates(docs, size, num).collect()}
        assert got == brute(rows, size, num, 100)


def test_hot_group_of_near_copies_chains_together(spark):
    rng = random.Random(1)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows, 3, 85, 100)
    # whole, and in blocks so small that all passes run
    for options in ({}, {"block": 16}, {"weight": 2000}):
        assert {tuple(r) for r in near_duplicates(docs, 3, 85, **options).collect()} == want


def test_all_small_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in near_duplicates(docs, 3, 85).collect()} == brute(rows, 3, 85, 100)


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (overlaps(sets) == want).all() and (overlaps(sets[:13], sets[13:]) == want[:13, 13:]).all()


@pytest.mark.parametrize("one_task", [0, 50, 10**6])
def test_components(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(5), Scratch(spark, "t"), one_task)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in got.collect()} == {(x, root(x)) for x in parent if x not in alone}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t"), one_task).count() == 0


def test_deduplicate_keeps_one_row_of_a_group(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long, "b", 1), (5, long, "a", 2), (None, long, "c", 3), (3, long + " end", "d", 4), (None, "x y", "e", 5), (None, "x y", "f", 6), (7, "p q", "g", 7), (7, "r s", "h", 8), (1, "", "i", 9), (1, "", "i", 9), (None, None, "j", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_shingles int")
    got = deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.component_id for r in got.collect())) == ["d", "e", "g", "h", "i", "i", "j"]
    assert deduplicate(docs.limit(0)).count() == 0


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "q")], "doc_id long, text string")
    assert sorted((tuple(r) for r in near_duplicates(docs, 3, 85).collect()), key=str) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 1, None, None)]
    assert near_duplicates(docs.limit(0)).count() == 0
