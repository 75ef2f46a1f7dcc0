"""Secret spans against a scan of every text with every rule."""

import hashlib
import random
import re

from kinfold.llm.secrets import BASE_RULES, RULES, find_secrets
from kinfold.llm.trigram import trigram_query


def brute(text):
    text = text or ""
    spans = []
    for k, r in enumerate(RULES):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m[r.group]) >= r.least:
                spans.append((m.start(), k, f"{r.kind}:{m.start()}:{m.end()}"))
    spans.sort()
    base = [s for s in spans if s[1] < len(BASE_RULES)]
    return (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(",".join(s[2] for s in base).encode()).hexdigest(), ",".join(s[2] for s in spans))


def test_trigram_queries_are_necessary():
    assert trigram_query("[0-9a-f]+") is None
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in trigram_query(RULES[0].pattern)
    assert trigram_query("(?:abc|x)y") is None
    assert trigram_query("(?:abcd)?efg[0-9]hij") == [frozenset({"efg", "hij"})]


def test_spans(spark):
    rng = random.Random(3)
    bits = ["token=secret:abcdef ", "token=token:abcdefgh ", 'PassWord = "hunter22!"', "é😀 ", "api-key: aaaaaaaa", "API_KEY:abc", "apikey='abcdef'", "AKIA" + "Q" * 16, "AKIA" + "Q" * 15 + " ", "a1" * 12, "a1" * 11 + " ", "passwd:" + "f" * 30,
            "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab", "AIza" + "b" * 35, "https://bob:pa55word@host.example", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "ASIA" + "X" * 16, "\n", "secret", ":", "=", " ", "ordinary words"]
    rows = [(0, None), (1, ""), (2, "\x00 token=abcdef"), (3, "x" * 300000 + " token=abcdef"), (4, "token=abcdef " * 3000)]
    rows += [(10 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for i in range(150)]
    rows += [rows[20], rows[20]]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, mark int, rules int")
    got = sorted(tuple(r) for r in find_secrets(docs).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)
    assert find_secrets(docs.limit(0)).count() == 0


def test_null_ids(spark):
    rows = [(None, "token=abcdef"), (None, "AKIA" + "Q" * 16), (None, "AKIA" + "Q" * 16), (None, None), (1, "token=abcdef"), (None, "a1" * 12)]
    got = [tuple(r) for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
