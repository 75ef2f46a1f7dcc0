"""Hand tables and brute force for the matching operators."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions.normalize import dealt, fold_text, normalize
from kinfold.functions.similarity import KERNELS, MANY, jaro_winkler, lcs, partial_ratio, partial_token_set_ratio, ratio, token_set_ratio, token_sort_ratio
from kinfold.operators import retrieval
from kinfold.operators.features import pair_features
from kinfold.operators.group import group_features
from kinfold.operators.mining import resolve_chains, select
from kinfold.operators.models import fit_stacker, load_models, predict_stacker, save_models
from kinfold.operators.selection import exact_sizes, expected_f05, expected_sizes, label_shift, one_to_one
from kinfold.operators.windows import ranks
from kinfold.plans import matching
from kinfold.plans.registry import text_search
from kinfold.sources.records import read_tsv, result_lists, truth_pairs


def brute_f05(q, k):
    total = 0.0
    for bits in itertools.product((0, 1), repeat=len(q)):
        p = np.prod([x if b else 1 - x for x, b in zip(q, bits)])
        tp, n = sum(bits[:k]), sum(bits)
        total += p * (float(k == 0) if n == 0 else 0.0 if tp == 0 else 1.25 * tp / (k + 0.25 * n))
    return total


def test_exact_expectation():
    for q in ([0.9, 0.6, 0.2], [1.0], [0.3, 0.3], [1.0, 0.5, 0.0], [0.8, 0.7, 0.6, 0.5, 0.4]):
        got = expected_f05(np.array([q]))[0]
        assert got == pytest.approx([brute_f05(q, k) for k in range(len(q) + 1)])


def test_set_sizes(spark):
    rows = [("a", "1", 0.9), ("a", "2", 0.6), ("a", "3", 0.2), ("b", "4", 1.0), ("c", "5", 0.3), ("c", "6", 0.3)]
    q = spark.createDataFrame(rows, "s1 string, rec string, q double")
    assert {r.s1: r.k for r in expected_sizes(q).collect()} == {"a": 1, "b": 1, "c": 0}
    assert {r.s1: r.k for r in exact_sizes(q).collect()} == {"a": 1, "b": 1, "c": 0}


def test_set_sizes_of_equal_expectation(spark):
    """More records are exactly as good as one, and a float's last place must not choose."""
    rows = [("a", "1", 0.96), ("a", "2", 0.64), ("a", "3", 0.4), ("b", "4", 0.91), ("b", "5", 0.65), ("b", "6", 0.04), ("c", "7", 0.18), ("c", "8", 0.16), ("c", "9", 0.16)]
    q = spark.createDataFrame(rows, "s1 string, rec string, q double")
    assert {r.s1: r.k for r in expected_sizes(q, bias=-1.0).collect()} == {"a": 1, "b": 1, "c": 1}


def test_one_to_one_ties(spark):
    p = spark.createDataFrame([("b", "r", 0.5), ("a", "r", 0.5), ("c", "r", None), ("c", "z", None)], "s1 string, rec string, p double")
    assert sorted((r.s1, r.rec) for r in one_to_one(p).collect()) == [("a", "r"), ("c", "z")]


def test_kernels():
    assert lcs("kitten", "sitting") == 4 and ratio("", "") == 100 and ratio("a", "") == 0
    assert ratio("small ring", "smal rng ltd") == pytest.approx(200 * 8 / 22)
    assert partial_ratio("abc", "xxabcxx") == 100 and partial_ratio("", "a") == 0
    assert token_sort_ratio("b a", "a b") == 100 and token_set_ratio("a b c", "a b") == 100 and token_set_ratio("", "") == 0
    assert partial_token_set_ratio("x a", "a y") == 100 and jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_kernels_of_batches():
    """To the last place those of a pair: empty, long, and texts that repeat, overlap or fill a machine word."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(rng.choice([0, 1, 3, 7, 25])))
    a = [text() for _ in range(3000)] + ["a" * 64, "a" * 65, "ab" * 32, " ", "abcd"]
    b = [text() if rng.random() < 0.6 else t[1:] for t in a[:3000]] + ["a" * 64, "a" * 66, "ba" * 32, "", "abcdefgh" * 8]
    for name, many in MANY.items():
        assert many(a, b).tolist() == [KERNELS[name](x, y) for x, y in zip(a, b, strict=True)], name
        assert len(many([], [])) == 0


def test_normal_forms(spark):
    rows = [("1", "Sri X.Y. Café Pvt Ltd", "null, 012 Main st, Paris, 9876543210"), ("2", "Old Co dba New & Sons Inc", ""), ("3", "राम | www.ram-shop.com", "5th r, n/a")]
    got = {r.id: r for r in normalize(spark.createDataFrame(rows, "id string, name string, addr string")).collect()}
    assert (got["1"].name_n, got["1"].core, got["1"].legal) == ("sri xy cafe pvt ltd", "xy cafe", "ltd pvt")
    assert (got["1"].addr_n, got["1"].nums, got["1"].phone) == ("12 main st, paris, 9876543210", "12", "9876543210")
    assert (got["2"].core, got["2"].alt, got["2"].addr_n) == ("new and sons", "old", "")
    assert got["3"].dom == "ramshop" and got["3"].name_native and got["3"].addr_n == "5 rue"
    assert fold_text("N° 5 Straße") == "no 5 strasse"


def test_chains_and_circles(spark):
    maps = spark.createDataFrame([("A", "k", "a", "b"), ("A", "k", "b", "c"), ("A", "k", "p", "q"), ("A", "k", "q", "p")], "country string, kind string, variant string, canonical string")
    assert {(r.variant, r.canonical) for r in resolve_chains(maps).collect()} == {("a", "c"), ("b", "c"), ("p", "q"), ("q", "p")}


def test_tab_separated_edges(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"open\tback\\\t\nS1-2\t"a"\t\tUS\n')
    got = sorted(tuple(r) for r in read_tsv(spark, str(tmp_path / "x.tsv")).collect())
    assert got == [("S1-1", '"open', "back\\", ""), ("S1-2", '"a"', "", "US")]


def test_result_lists_round_trip(spark):
    pairs = spark.createDataFrame([("a", "2"), ("a", "1")], "s1 string, rec string")
    s1 = spark.createDataFrame([("a",), ("b",)], "s1 string")
    out = result_lists(pairs, s1)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "1,2"), ("b", "")]
    assert sorted(tuple(r) for r in truth_pairs(out).collect()) == [("a", "1"), ("a", "2")]
    assert out.where(F.col("matched_entity_ids") == "").count() == 1


def test_dictionaries_apply(spark):
    rows = [("1", "Рхино маркет", "12 Main St, NY, 5 zone st", "A"), ("2", "Рхино маркет", "12 Main St, NY", "B"), ("3", None, None, "A")]
    maps = [("A", "name_tok", "рхино", "rhino"), ("A", "addr_comp", "ny", "new york"), ("A", "addr_tok", "st", "saint")]
    docs = spark.createDataFrame(rows, "id string, name string, addr string, country string")
    entries = spark.createDataFrame(maps, "country string, kind string, variant string, canonical string")
    got = {r.id: r for r in normalize(docs, entries, spark.createDataFrame([("A", "5 zone st")], "country string, comp string")).collect()}
    assert (got["1"].name_n, got["1"].addr_n, got["1"].name_native) == ("rhino market", "12 main saint, new york", True)
    assert (got["2"].name_n, got["2"].addr_n) == ("rkhino market", "12 main st, ny") and got["3"].name_n == ""
    assert normalize(docs, entries).columns == normalize(docs).columns


def test_normal_forms_plan(spark):
    """The layers of names stay out of the plan of addresses, and few files are many tasks."""
    docs = spark.createDataFrame([("1", "Sri Café dba New Ltd", "5th r", "A")], "id string, name string, addr string, country string")
    plan = normalize(docs.coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "formerly known as" not in plan and "name_n" in plan
    assert dealt(docs.coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pair_inputs(spark):
    """Of the pair features the models' alone are computed, with the values that all together have."""
    rows = [("S1-1", 1, "Acme North Ltd", "12 Main St, Paris", "A"), ("S1-2", 1, "Zone Co", "7 High rd", "A"), ("S2-1", 2, "ACME North", "012 Main street", "A"), ("S2-2", 2, "Zon Company", "", "A")]
    norm = normalize(spark.createDataFrame(rows, "entity_id string, src int, name string, addr string, country string"))
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-2", "S2-2")], "s1 string, rec string")
    few, all_ = matching.pair_inputs(pairs, norm), pair_features(pairs, norm)
    kernels = [df._jdf.queryExecution().optimizedPlan().toString().count("scored(") for df in (few, all_)]
    assert 0 < kernels[0] < kernels[1] - 8, kernels
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, all_.select(*few.columns).collect()), key=str)


def test_text_search(spark):
    """Each side's asked rows against every row of the other, as by brute force, over several blocks; no vector is shuffled."""
    texts = [(f"S{1 + k % 3}-{k}", "AB"[k % 7 == 0], f"{'acme north zone'[k % 5:]} {k % 11} {chr(97 + k % 23)} road") for k in range(1500)]
    df = spark.createDataFrame(texts, "id string, country string, text string")
    retrieval.BLOCK, block = 100, retrieval.BLOCK
    try:
        found = text_search(df)
        got = sorted(tuple(r) for r in found.select("s1", "rec", "cos", "rf", "rr").collect())
    finally:
        retrieval.BLOCK = block
    assert "array<float>" not in found._jdf.queryExecution().analyzed().toString()
    x = retrieval.NgramEncoder(128).fit(df).encode(pd.Series([t for _, _, t in texts])).astype(float)
    want = {}
    for own, k, place in ((True, 5, 3), (False, 2, 4)):
        for i, (name, country, _) in enumerate(texts):
            if name.startswith("S1-") == own and i % 20 == 0:
                keys = [(-round(float(x[i] @ x[j]), 6), texts[j][0]) for j in range(len(texts)) if texts[j][1] == country and texts[j][0].startswith("S1-") != own]
                for rank, (cos, other) in enumerate(sorted(keys)[:k]):
                    pair = (name, other) if own else (other, name)
                    want.setdefault(pair, [*pair, -cos, 255, 255])[place] = rank
    assert [(r[0], r[1], r[3], r[4]) for r in got] == sorted((a, b, f, r) for a, b, _, f, r in want.values())
    assert all(abs(r[2] - want[r[:2]][2]) < 2e-6 for r in got)


def test_mutual_neighbours(spark):
    """Both ways of every row in one meeting of blocks, as `knn` has them; equal, empty and short texts are among them."""
    texts = [(f"S{1 + k % 3}-{k}", "AB"[k % 7 == 0], "" if k % 50 == 9 else f"{'acme north zone'[k % 5:]} {k % 11} {chr(97 + k % 23)} {k * 37 % 1999 * (k % 4 > 0)} road") for k in range(2400)]
    df = spark.createDataFrame([*texts, ("S1-x", "C", "alone"), ("S2-y", "C", "alone too"), ("S1-z", "D", "none")], "id string, country string, v string")
    encode = retrieval.NgramEncoder().fit(df.withColumnRenamed("v", "text")).encode
    own = F.startswith("id", F.lit("S1-"))
    sides = df.where(own), df.where(~own)
    retrieval.MUTUAL, block = 300, retrieval.MUTUAL
    try:
        got = retrieval.mutual(*sides, 5, 2, encode).collect()
    finally:
        retrieval.MUTUAL = block
    want = {(r.s1, r.rec): r for r in retrieval.knn(*sides, 5, 2, encode).collect()}
    assert {(r.s1, r.rec): (r.rf, r.rr) for r in got} == {k: (r.rf, r.rr) for k, r in want.items()}
    assert len(got) == len(want) and all(abs(r.cos - want[r.s1, r.rec].cos) < 2e-6 for r in got)


def test_match_reads_and_joins_no_vectors(spark):
    """A group's cosines come from texts and are those of vectors; a record's tokens, not a pair's, are joined with their idf."""
    rows = [("S1-1", 1, "Acme North Ltd", "12 Main St, Paris", "A"), ("S2-1", 2, "ACME North", "012 Main street", "A"), ("S2-2", 2, "Acme Nord", "", "A"), ("S3-3", 3, "Acme", "12 Main St", "A")]
    norm = normalize(spark.createDataFrame(rows, "entity_id string, src int, name string, addr string, country string"))
    pred = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.8), ("S1-1", "S3-3", 0.7)], "s1 string, rec string, p double")
    texts = retrieval.view_text(norm)
    encoder = retrieval.NgramEncoder().fit(texts)
    found = group_features(pred, norm, encode=encoder.encode)
    assert "array<float>" not in found._jdf.queryExecution().analyzed().toString()
    got, want = (sorted(map(tuple, df.collect())) for df in (found, group_features(pred, norm, encoder.transform(texts))))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(x == pytest.approx(y, abs=1e-6) for g, w in zip(got, want, strict=True) for x, y in zip(g[2:], w[2:], strict=True))
    plan = matching.pair_inputs(pred.select("s1", "rec"), norm)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [s1" in line]


def test_dictionaries_select_and_chain(spark):
    maps = [("A", "addr_tok", "st", "street", 40), ("A", "addr_tok", "st", "saint", 10), ("A", "addr_tok", "rd", "road", 19), ("A", "addr_tok", "ave", "avenue", 20), ("A", "addr_tok", "ave", "av", 14), ("A", "name_tok", "x", "y", 3), ("A", "name_tok", "y", "z", 5), ("A", "addr_comp", "ny", "new york", 30), ("B", "addr_tok", "bd", "bl", 20), ("B", "addr_tok", "bd", "bk", 20), ("B", "addr_tok", "zz", "street", 50)]
    kept = select(spark.createDataFrame(maps, "country string, kind string, variant string, canonical string, n long"))
    assert {(r.country, r.variant, r.canonical) for r in kept.collect()} == {("A", "st", "street"), ("A", "x", "y"), ("A", "y", "z"), ("A", "ny", "new york")}
    assert {(r.variant, r.canonical) for r in resolve_chains(kept).where("kind = 'name_tok'").collect()} == {("x", "z"), ("y", "z")}


def test_ranks_of_a_hot_key(spark):
    rows = [("hot" if k % 10 else f"c{k % 30}", (k * 7919) % 4001) for k in range(4000)]
    got = ranks(spark.createDataFrame(rows, "country string, v int").repartition(5), ["country"], "v").collect()
    for key in {c for c, _ in rows}:
        of = sorted(v for c, v in rows if c == key)
        assert sorted((r._rank, r.v, r._n) for r in got if r.country == key) == [(i + 1, v, len(of)) for i, v in enumerate(of)]
    assert ranks(spark.createDataFrame([], "country string, v int"), ["country"], "v").count() == 0


def test_label_shift_by_bisection(spark):
    rng = np.random.default_rng(0)
    q = rng.random(500)
    pairs = spark.createDataFrame([(float(x),) for x in [*q, 0.0, 1.0]], "q double")
    odds = np.log(np.clip(np.append(q, [0, 1]), 1e-6, 1 - 1e-6) / (1 - np.clip(np.append(q, [0, 1]), 1e-6, 1 - 1e-6)))
    for target in (0.1, 0.6, 3.0):
        low, high = 0.0, 6.0
        for _ in range(12):
            mid = (low + high) / 2
            n = (odds >= mid).sum() / 200
            if abs(n - target) < 0.002:
                break
            low, high = (mid, high) if n > target else (low, mid)
        assert label_shift(pairs, target, 200) == mid


def test_saved_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"s{k % 40}", f"r{k}", float(x), int(x + 0.1 * y > 0.5)) for k, (x, y) in enumerate(rng.random((300, 2)))]
    feat = spark.createDataFrame(rows, "s1 string, rec string, f double, y int")
    models = fit_stacker(feat, ["f"], k=2, rounds=2, depth=2)
    save_models(models, f"file://{tmp_path}/m")
    a, b = (sorted((r.rec, r.p) for r in predict_stacker(m, feat, ["f"], "false").collect()) for m in (models, load_models(f"file://{tmp_path}/m", 2)))
    assert a == b
