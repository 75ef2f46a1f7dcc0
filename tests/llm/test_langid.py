"""Code lengths against a plain implementation; held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

from kinfold.llm import langid


def plain_bits(train: list[bytes], text: bytes, symbol, rare: int) -> float:
    counts: dict[tuple, dict[int, int]] = {}

    def walk(s):
        s = [symbol[32]] * langid.ORDER + [int(symbol[langid.LOWER[b]]) for b in s]
        for i in range(langid.ORDER, len(s)):
            yield tuple(int(x) for x in s[i - langid.ORDER : i]), s[i]

    for t in train:
        for ctx, sym in walk(t):
            for k in range(langid.ORDER + 1):
                c = counts.setdefault(ctx[k:], {})
                c[sym] = c.get(sym, 0) + 1
    bits = 0.0
    for ctx, sym in walk(text):
        p = 1.0
        for k in range(langid.ORDER + 2):
            if k == langid.ORDER + 1:
                p /= langid.SYMBOLS - 1 + rare
                break
            c = counts.get(ctx[k:])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if sym in c:
                p *= c[sym] / (n + q)
                break
            p *= q / (n + q)
        bits -= math.log2(p)
    return bits


def test_code_lengths(spark):
    train = ["The cat sat on the mat", "les élèves où ça", "the dog", "", "été"]
    rows = [(i, t, "en" if t.isascii() else "fr") for i, t in enumerate(train)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    assert model.langs == ["en", "fr"]
    table = model.table()
    rare = int((model.symbol == langid.SYMBOLS - 1).sum())
    for text in (b"the mat", "où été Ω".encode(), b"zzz"):
        code = langid._codes(np.frombuffer(text, np.uint8), np.array([0]), model.symbol)
        for k, lang in enumerate(model.langs):
            want = plain_bits([t.encode() for _, t, x in rows if x == lang], text, model.symbol, rare)
            assert table[code, k].sum() == pytest.approx(want, rel=1e-4)


def test_edge_cases(spark):
    rows = [(i, t, x, "s", 0.5) for i, (t, x) in enumerate([("hello there friend", "en"), ("bonjour mes amis", "fr"), (None, "en"), ("", "fr"), ("123 --", None), ("hello", None), ("x" * 300000, "xx")] * 8)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, held_out string, score double")
    got = langid.identify_held_out(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = rows[r.doc_id][1]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und" and r.score == 0) if text is None or not any(c.isalpha() for c in text) else r.lang_pred in ("en", "fr", "xx") and 0 < r.score <= 1
    assert langid.identify_held_out(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_scripts_beside_a_latin_majority(spark):
    """Every byte keeps its symbol, however many others are more frequent."""
    latin = ("hello there my friend " + "".join(chr(c) for c in range(32, 127))) * 40
    train = [(latin, "en"), ("привет мир как твои дела сегодня", "ru"), ("привіт світ як твої справи сьогодні", "uk"), ("γεια σου κόσμε τι κάνεις σήμερα", "el")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.learn(docs, langid.F.lit(True))
    texts = ["как дела", "як справи", "τι κάνεις", "hello"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {0: "ru", 1: "uk", 2: "el", 3: "en"}
    data = np.arange(256, dtype=np.uint8)
    codes = langid._codes(np.delete(data, range(65, 91)), np.array([0]), model.symbol)
    assert len(set((codes % langid.SYMBOLS).tolist())) == 230
