"""Weights against a direct search, budgets, permutations."""

import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm.mixing import _dealt, mix, n_words


def corpus(spark, seed=4):
    rng = random.Random(seed)
    rows = []
    for k, n in enumerate([1500, 300, 120, 40, 5]):
        rows += [(len(rows) + i, "w " * rng.randrange(1, 40), f"s{k}", 0.1) for i in range(n)]
    rows += [(10_000, None, "s0", 0.0), (10_001, "", None, 0.0), (10_002, "a b", None, 0.0), (10_003, "", "empty", 0.0), (0, rows[0][1], "s0", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"), rows


def entropy(p):
    return -sum(x * math.log(x) for x in p if x > 0)


def test_weights_and_budgets(spark):
    docs, rows = corpus(spark)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    total = sum(size.values())
    for gain, limit in ((0.5, None), (0.5, 4.0), (0.0, None), (1.0, 3.0)):
        got = mix(docs, gain, limit).collect()
        used = {}
        for r in got:
            used[r.source] = used.get(r.source, 0) + r.words * r.copies
        w = {r.source: r.weight for r in got}
        h = entropy([x / total for x in size.values() if x])
        target = h + gain * (math.log(sum(x > 0 for x in size.values())) - h)
        if limit is None:
            assert entropy(w.values()) == pytest.approx(target, abs=1e-3)
        else:
            assert all(w[s] * total / x <= limit * (1 + 1e-6) for s, x in size.items() if x)
        for s, x in size.items():
            if x:
                assert w[s] * total - 60 <= used[s] <= w[s] * total + 1e-6 * total
        assert {r.doc_id for r in got if r.source == "empty"} == {10_003}
        assert sorted(map(tuple, mix(docs.repartition(7), gain, limit).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_words_and_empty_table(spark):
    docs, _ = corpus(spark)
    texts = spark.createDataFrame([(" a\tb\n\nc\x0b d ",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(n_words(F.col("t"))).collect()] == [4, 0, 0]
    assert mix(docs.limit(0)).count() == 0


def brute(cells, plan_weights, total, seed):
    """Copies of each cell (source, block, part) by the rule itself: whole epochs, blocks that fit in their order, parts of the first that doesn't."""

    def place(seed, *values):
        h = 42
        for v in (seed, *values):
            data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
        return h - (h >> 63 << 64)

    copies, size, blocks = {}, {}, {}
    for (s, b, p), n in cells.items():
        size[s] = size.get(s, 0) + n
        blocks.setdefault(s, {}).setdefault(b, {})[p] = n
    for s, of in blocks.items():
        budget = plan_weights[s] * total if size[s] else 0
        epochs = int(budget / size[s] + 1e-9) if size[s] else 1
        left, more = max(budget - epochs * size[s], 0) if size[s] else 0, set()
        sums = {b: sum(parts.values()) for b, parts in of.items() if sum(parts.values())}
        for b in sorted(sums, key=lambda b: (place(seed, s, b), b)):
            if sums[b] <= left:
                left -= sums[b]
                more |= {(b, p) for p in of[b]}
                continue
            parts = {p: n for p, n in of[b].items() if n}
            for p in sorted(parts, key=lambda p: (place(seed + 1, s, b, p), p)):
                if parts[p] > left:
                    break
                left -= parts[p]
                more.add((b, p))
            break
        for b in of:
            for p, n in of[b].items():
                copies[s, b, p] = epochs + ((b, p) in more)
    return copies


@pytest.mark.parametrize("most_broadcast", [0, 2000])
def test_against_the_rule(spark, most_broadcast):
    docs, _ = corpus(spark)
    dealt = [(r["its cell"], r) for r in _dealt(docs, 3).collect()]
    cells = {}
    for c, r in dealt:
        cells[tuple(c)] = cells.get(tuple(c), 0) + r.words
    got = mix(docs, seed=3, most_broadcast=most_broadcast)
    assert got.columns == ["doc_id", "text", "source", "words", "weight", "copies"]
    w = {("=" + r.source if r.source is not None else ""): r.weight for r in got.collect()}
    want = brute(cells, w, sum(cells.values()), 3)
    # a document without words is taken in whole epochs alone
    size = {}
    for (s, _, _), n in cells.items():
        size[s] = size.get(s, 0) + n
    whole = {s: int(w.get(s, 0) * sum(size.values()) / n + 1e-9) if n else 1 for s, n in size.items()}
    rows = sorted((str(r.doc_id), str(r.text), n) for c, r in dealt if (n := want[tuple(c)] if r.words else whole[c.source]))
    assert sorted((str(r.doc_id), str(r.text), r.copies) for r in got.collect()) == rows


def test_rows_without_an_id_and_long_texts(spark):
    rows = [(None, f"t{k} x", "a", k) for k in range(300)] + [(None, "w " * 300_000, "b", 1), (7, None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    got = mix(docs, 0.0, None)
    assert got.columns == [*docs.columns, "words", "weight", "copies"]
    assert sorted(r.block for r in got.collect()) == sorted(r[3] for r in rows) and {r.words for r in got.where("source = 'b'").collect()} == {0, 300_000}
    assert _dealt(docs, 0).select("its cell.block").distinct().count() > 100
