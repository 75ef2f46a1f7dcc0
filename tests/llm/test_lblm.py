"""Base scores against a plain count, normalised probabilities, and gain over the base on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import lblm


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_and_normalisation(spark):
    texts = [None, "", "The cat É sat", "the dog\nsat \x0b down É", "zzz"] * 8
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(3, texts[3], 1.0)]
    got = lblm.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), ~lblm.held_out()).collect()
    train = Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for w in toks(t))
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    for r in got:
        t = toks(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(train[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0
    assert lblm.score(spark.createDataFrame(rows, "doc_id long, text string, score double").limit(0), ~lblm.held_out()).count() == 0


def small_model():
    rng = np.random.default_rng(0)
    hashes = rng.integers(1, 2**63, 40, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    outputs = lblm.Outputs(hashes, rng.integers(1, 500, 40), rng.random(lblm.KINDS) * 90 + 1, 9000, 900)
    model = lblm.Model(outputs)
    for part in model.parts():
        part += rng.normal(0, 0.3, part.shape).astype(np.float32)
    return model, hashes, rng


def plain_probabilities(model, context):
    """Of all outputs after one context, by the definition."""
    o = model.outputs
    q = sum(model.context[c] @ m for c, m in zip(context, model.mixing))
    q = np.append(q, 1.0).astype(float)
    classes = np.exp(model.classes.astype(float) @ q)
    p = (classes / classes.sum())[o.class_of]
    for c in range(o.n_word_classes):
        inside = np.exp(model.word[o.edge[c] : o.edge[c + 1]].astype(float) @ q)
        p[o.edge[c] : o.edge[c + 1]] *= inside / inside.sum()
    return p


def test_probabilities_are_those_of_the_definition_and_sum_to_one():
    model, hashes, rng = small_model()
    o = model.outputs
    assert sorted(o.of(hashes)) == list(range(40)) and (o.of(hashes + np.uint64(1)) == 40 + (hashes >> np.uint64(58)).astype(int)).all()
    every = np.arange(o.size)
    for context in rng.integers(0, o.size + 1, (20, lblm.CONTEXT)):
        p = plain_probabilities(model, context)
        assert p.sum() == pytest.approx(1)
        assert np.exp(model.log_probabilities(np.tile(context, (o.size, 1)), every)) == pytest.approx(p, rel=1e-4)


def test_scores_against_the_definition():
    model, _, _ = small_model()
    o = model.outputs
    texts = ["a b c a b", None, "zz É a zz qq b", "long " * 900]
    hashes = [h for *_, h, _ in lblm.tokens(pa.array(texts))]
    found = np.concatenate(hashes)
    model.outputs.sorted[:4] = np.sort(np.unique(found)[:4])  # some of the words are in the vocabulary
    model.outputs.sorted.sort()
    rare = np.unique(found[o.of(found) >= o.words])
    known, count = rare[::2], np.arange(len(rare[::2])) + 1
    got = lblm._Scorer(model)(pa.array(texts), known, count)
    for i, text in enumerate(texts):
        h = next(iter(lblm.tokens(pa.array([text], pa.string()))))[2]
        y, total, base = o.of(h), 0.0, 0.0
        for k in range(len(h)):
            context = [y[k - j] if k >= j else o.size for j in range(1, lblm.CONTEXT + 1)]
            c = o.count[y[k]] if y[k] < o.words else dict(zip(known.tolist(), count)).get(int(h[k]), 0)
            p = lblm.GAIN * plain_probabilities(model, context)[y[k]] + (1 - lblm.GAIN) * o.share[y[k]]
            total += math.log10(p * ((c + 0.1) / o.mass[y[k]] if y[k] >= o.words else 1))
            base += math.log10((c + 0.1) / (o.total + 0.1 * (o.kinds + 1)))
        assert got[3][i] == pytest.approx(total, rel=1e-4) and got[2][i] == pytest.approx(base) and got[0][i] == len(h)


def test_contexts_stay_within_rows():
    got = lblm._contexts(np.array([1, 2, 3, 4, 5, 6]), np.array([0, 1, 4, 6]), 9)
    assert got[:, :2].tolist() == [[9, 9], [9, 9], [2, 9], [3, 2], [9, 9], [5, 9]] and got[3].tolist() == [3, 2, 9]


def test_better_than_base_on_held_out_text_and_the_same_however_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, eight = ({r.doc_id: r for r in lblm.score(docs.repartition(n), ~lblm.held_out(), 400_000).collect()} for n in (1, 8))
    for i, r in one.items():
        assert r.score == pytest.approx(eight[i].score, rel=1e-3) and r.base_score == pytest.approx(eight[i].base_score)
    held = [r for r in one.values() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / n > 0.02


def test_without_training_documents_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "w " * 300_000)], "doc_id long, text string")
    got = lblm.score(docs, F.lit(False)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 300_001] and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 and math.isfinite(r.score) for r in got)


def test_every_position_is_a_target(spark):
    """The model of a chunk is that of one pass over all positions of its text."""
    text = " ".join(f"w{(k * k) % 7} v{k % 5}" for k in range(300))
    (_, _, h, at), *_ = lblm.tokens(pa.array([text]))
    kinds, count = np.unique(h, return_counts=True)
    outputs = lblm.Outputs(kinds, count, np.full(lblm.KINDS, 0.1), len(h), len(kinds))
    rows = spark.createDataFrame([(0, True, text, 1, 1)], "chunk int, train boolean, text string, place long, doc_id long")
    _, got = lblm._trained(rows, lblm.Model(outputs), lblm.Scratch(spark, "test"))
    want, y = lblm.Model(outputs), outputs.of(h)
    want.train(lblm._contexts(y, at, outputs.size), y, np.random.Generator(np.random.PCG64(0)), lblm.RATES[1])
    assert np.allclose(got.flat(), want.flat(), atol=1e-5)
