"""Pseudonyms: permutations, valid within their format, linked across documents."""

import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm.pii import KINDS, Pseudonyms, feistel, luhn_digit, pseudonymise


def test_feistel_permutes_every_range():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(feistel(v, size, b"k" * 32, b"t") for v in range(size)) == list(range(size))


def test_values_keep_their_format():
    p = Pseudonyms(b"key")
    text, n = p("card 4111 1111 1111 1111, and 4111-1111-1111-1111; 4111111111111112 no. Mail ann.lee99@mail.example.com on 2021-03-04 or 4/3/2021. +1 (743) 555-3824, 227.5.221.1. SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00, 31/02/2020")
    assert dict(zip(KINDS, n)) == {"email": 1, "phone": 1, "ip": 1, "card": 2, "ssn": 1, "iban": 1, "date": 2}
    cards = re.findall(r"card ([\d ]{19}), and ([\d-]{19});", text)[0]
    a, b = (re.sub(r"\D", "", c) for c in cards)
    assert a == b != "4111111111111111" and luhn_digit(a[:-1]) == a[-1]
    assert "4111111111111112 no" in text and "31/02/2020" in text
    iso, plain = re.search(r"on (\S+) or (\S+)\.", text).groups()
    assert datetime.strptime(iso, "%Y-%m-%d") == datetime.strptime(plain, "%d/%m/%Y") != datetime(2021, 3, 4)
    assert re.search(r"Mail [a-z]{3}\.[a-z]{3}\d\d@mail\.example\.com", text) and "ann.lee99" not in text
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}, \d+\.\d+\.\d+\.\d+\.", text) and "555-3824" not in text
    iban = re.search(r"IBAN (DE[\d ]{25})", text)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("0123456789 .-/@()+abAB,é"), max_size=120))
def test_counts_follow_changes(text):
    new, n = Pseudonyms(b"k")(text)
    assert len(new) == len(text) or n[KINDS.index("ip")] or n[KINDS.index("date")]
    assert sum(n) or new == text


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "x@mail.example.com", 7), (4, "x@mail.example.com " * 20000, 7), (3, "x@mail.example.com", 7)], "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in pseudonymise(docs, b"k", counted=True).collect()}
    assert got[1].text is None and got[2].text == "" and got[3].n_email == 1 and got[4].n_email == 20000
    assert got[4].text.startswith(got[3].text) and pseudonymise(docs, b"k").count() == 5
    assert pseudonymise(docs.limit(0), b"k").count() == 0
    plain = pseudonymise(docs, b"k")
    assert plain.columns == docs.columns and {r.n_email for r in plain.collect()} == {7}


def test_values_beside_other_characters():
    """A longest match that fails leaves its valid part to be found."""
    change = Pseudonyms(b"k")
    card, iban = "4111 1111 1111 1111", "ES9121000418450200051332"
    cases = [(card, f"{card} 12/26"), (card, f"{card} 123"), (card.replace(" ", ""), f"{card.replace(' ', '')} 123"), (card, f"order 7 {card}"), (card, f"call 555-123-4567 {card} 123"), (iban, f"{iban} EUR 30"), (iban, f"AB12 {iban} EUR 30")]
    cases.append(("ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1332 THIS COST"))
    cases.append(("+44 20 7946 0958", "+44 20 7946 0958 1230 1530"))
    for value, text in cases:
        new, counts = change(text)
        alone, _ = change(value)
        assert alone != value and value not in new
        assert sum(counts) == 1 + ("call" in text), (text, new)
    for value, text in cases[:4] + cases[5:8]:
        assert change(text)[0] == text.replace(value, change(value)[0]), text
