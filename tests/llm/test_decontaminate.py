"""Leaks against SQL over the tokens, and on edited passages."""

import random

import duckdb

from kinfold.llm.decontaminate import leaks, leaks_sql, without_leaks


def tables():
    rng = random.Random(11)
    vocab = ["the", "of", "and", "in"] * 40 + [f"tok{k}é" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([9, 12, 20, 35, 60, 4, 15])] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "the of and in " * 500)]
    for i in range(3, 90):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if i % 3:
            p = items[rng.randrange(7)][1].split()
            for _ in range(rng.randrange(0, 1 + len(p) // 6)):
                p[rng.randrange(len(p))] = "changed"
            if i % 5 == 0:
                p = p[: len(p) // 2]
            w[len(w) // 2 : len(w) // 2] = p
        docs.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    return docs + [docs[10], docs[10]], items


def test_against_sql(spark):
    docs, items = tables()
    d, b = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, seed int")
    got = sorted(tuple(r) for r in leaks(d, b).collect())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    assert got == sorted(con.execute(leaks_sql()).fetchall())
    assert len({g[0] for g in got}) > 30
    kept = {r.doc_id for r in without_leaks(d, b).collect()}
    assert kept == {r[0] for r in docs} - {g[0] for g in got}


def test_empty_tables(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks(d, b.limit(0)).count() == 0 and leaks(d.limit(0), b).count() == 0
    assert without_leaks(d, b.limit(0)).count() == len(docs)


def test_bitmap_stands_once_in_the_plan(spark):
    """The driver describes a plan many times over, so the benchmark's bitmap may not be copied within it."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    assert leaks(docs, items)._jdf.queryExecution().optimizedPlan().toString().count("getbit(") == 1
