"""Held-out accuracy, edge cases and rejection."""

import random

from kinfold.llm.toxicity import learn, reject_toxic, score, toxicity


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    vocab = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(10, 150))]
        toxic = rng.random() < 0.2
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "übelkopf" + rng.choice("abc")]))
        bad = not toxic and rng.random() < 0.2
        if bad:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, p_toxic string")
    chain = learn(d, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in score(d, chain).collect()}
    assert len(got) == len(docs)
    for name, want in (("p_toxic", lambda x: x[2] == 1), ("p_low_quality", lambda x: x[1] == 0)):
        assert sum((got[x[0]][name] >= 0.5) == want(x) for x in labels[600:]) >= 0.98 * 300


def test_edge_cases(spark):
    docs, labels = corpus(200)
    more = [(1000, None, "en", "s"), (1001, "", None, None), (1002, "nitwit " * 800_000, "en", "s"), (1003, docs[0][1], "en", "s"), (1003, docs[0][1], "en", "s")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, lang string, toxic string")
    known = spark.createDataFrame([*labels, (5, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity(d, known).collect()
    assert len(got) == len(docs) + 5
    by = {r.doc_id: r.toxic for r in got}
    assert not by[1000] and not by[1001] and by[1002]
    kept = reject_toxic(d, known)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.toxic)
    assert toxicity(d.limit(0), known).count() == 0
    assert not any(r.toxic for r in toxicity(d, known.limit(0)).collect())
