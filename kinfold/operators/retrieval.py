"""Candidates: exact nearest neighbours within a country, key blocks, unions of views, pruning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.relational import cap_keys, full_join_views
from kinfold.tables import written

BLOCK, ROWS = 16_384, 512
#: Rows of a block of texts that both sides search, and the tiles in which it is bounded.
MUTUAL, TILE = 65_536, (512, 1024)
#: What single precision may take from a bound.
SLACK = 1e-5
ABSENT = 255
Encode = Callable[[pd.Series], np.ndarray]


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v):
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _top(queries: pd.DataFrame, keys: pd.DataFrame, k: int, encode: Encode | None = None) -> pd.DataFrame:
    """The k best keys of one block for each query of one block; scores rounded to 6 places, ties to the lesser id."""
    q, x = (encode(df["v"]) if encode else np.stack(df["v"]) for df in (queries, keys))
    q, x, rows, cols, scores = q.astype(np.float64), x.astype(np.float64), [], [], []
    n = min(k, len(x))
    for at in range(0, len(q), ROWS):
        cos = q[at : at + ROWS] @ x.T
        # rounding keeps the order, so the last of the best is that of the rounded ones
        edge = np.round(np.partition(cos, len(x) - n, axis=1)[:, len(x) - n], 6)
        row, col = np.nonzero(cos >= edge[:, None] - 1e-6)
        score = np.round(cos[row, col], 6)
        near = score >= edge[row]
        rows.append(row[near] + at)
        cols.append(col[near])
        scores.append(score[near])
    row, score = np.concatenate(rows), np.concatenate(scores)
    ids = keys["id"].to_numpy()[np.concatenate(cols)]
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return pd.DataFrame({"q": queries["id"].to_numpy()[row[keep]], "id": ids[keep], "cos": score[keep]})


def nearest(queries: DataFrame, keys: DataFrame, k: int, encode: Encode | None = None) -> DataFrame:
    """q, id, cos, rank (from 0): for each query the k keys of its country by inner product, exactly.

    Blocks of queries meet blocks of keys as matrix products, so a hot country is many tasks; each
    block keeps its k best and a window merges them. Both tables: country, id, v. With encode, v is
    what it makes vectors of, such as a text, and that is all that is shuffled.
    """
    kind, spark = dict(queries.dtypes)["id"], queries.sparkSession
    counts = queries.groupBy("country").agg(F.count(F.lit(1)).alias("nq")).join(keys.groupBy("country").agg(F.count(F.lit(1)).alias("nk")), "country")
    counts = counts.select("country", F.ceil(F.col("nq") / BLOCK).cast("int").alias("qbs"), F.ceil(F.col("nk") / BLOCK).cast("int").alias("kbs"))
    left = queries.join(counts, "country").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("qbs")).cast("int")).withColumn("kb", F.explode(F.sequence(F.lit(0), F.col("kbs") - 1)))
    right = keys.join(counts, "country").withColumn("kb", F.pmod(F.xxhash64("id"), F.col("kbs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _top(a, b, k, encode) if len(a) and len(b) else pd.DataFrame({"q": a["id"][:0], "id": b["id"][:0], "cos": pd.Series([], dtype=float)})

    by = ["country", "qb", "kb"]
    # a block is little to read and much to do: the number of tasks is given, not left to sizes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    side = lambda df: df.select(*by, "id", "v").toDF(*by, "id", "v").repartition(tasks, *by).groupBy(*by)
    found = side(left).cogroup(side(right)).applyInPandas(search, f"q {kind}, id {kind}, cos double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "id")) - 1
    return found.withColumn("rank", rank).where(F.col("rank") < k)


def knn(s1: DataFrame, records: DataFrame, kf: int, kr: int, encode: Encode | None = None, asked: Column | None = None) -> DataFrame:
    """s1, rec, cos, rf, rr: forward and reverse neighbours merged; a rank that is absent is null. asked: which rows of either side are queries, all if not given; every row is a key."""
    queries = lambda df: df if asked is None else df.where(asked)
    forward = nearest(queries(s1), records, kf, encode).select(F.col("q").alias("s1"), F.col("id").alias("rec"), "cos", F.col("rank").alias("rf"), F.lit(None).cast("int").alias("rr"))
    back = nearest(queries(records), s1, kr, encode).select(F.col("id").alias("s1"), F.col("q").alias("rec"), "cos", F.lit(None).cast("int").alias("rf"), F.col("rank").alias("rr"))
    return forward.union(back).groupBy("s1", "rec").agg(F.max("cos").alias("cos"), F.min("rf").alias("rf"), F.min("rr").alias("rr"))


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides' rows in one common order of texts, and the place of each among the other side's rows."""
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    right = order >= len(a)
    return order[~right], order[right] - len(a), np.cumsum(right)[~right], np.cumsum(~right)[right]


def _floor(q: np.ndarray, x: np.ndarray, rows: np.ndarray, keys: np.ndarray, at: np.ndarray, k: int, floor: np.ndarray) -> None:
    """Raises floor to the k-th best product of each query with the keys about its place: no more than that with all keys."""
    k = min(k, len(x))
    for lo in range(0, len(rows), ROWS):
        tile, places = rows[lo : lo + ROWS], at[lo : lo + ROWS]
        first = max(0, min(places[0] - ROWS // 2, len(x) - k))
        for begin in range(first, max(places[-1] + ROWS // 2, first + k), BLOCK):
            near = keys[begin : min(begin + BLOCK, max(places[-1] + ROWS // 2, first + k))]
            if len(near) >= k:
                cos = q[tile] @ x[near].T
                floor[tile] = np.maximum(floor[tile], np.partition(cos, len(near) - k, axis=1)[:, len(near) - k])


def _best(by: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each `by` are; ties to the lesser other."""
    order = np.lexsort((other, -score, by))
    by = by[order]
    return order[np.arange(len(by)) - np.searchsorted(by, by) < k]


def _split(v: np.ndarray, basis: np.ndarray, m: int, tile: int) -> np.ndarray:
    """The first m coordinates in the basis and the length of the rest, with empty rows up to whole tiles."""
    out = np.zeros((-(-len(v) // tile) * tile, m + 1), np.float32)
    for lo in range(0, len(v), BLOCK):
        turned = v[lo : lo + BLOCK] @ basis
        out[lo : lo + len(turned), :m] = turned[:, :m]
        out[lo : lo + len(turned), m] = np.linalg.norm(turned[:, m:], axis=1)
    return out


def _mutual(a: pd.DataFrame, b: pd.DataFrame, ka: int, kb: int, encode: Encode) -> pd.DataFrame:
    """For each row of a the ka best of b and for each of b the kb best of a, exactly as `_top` has them; back tells the second.

    In the axes that hold most of b's length, the product of the first coordinates and of the lengths
    of the rest is never less than the product of two vectors. Only pairs whose bound reaches what the
    rows about them in the order of texts, read from either end, already give are multiplied in full.
    """
    vectors = lambda v: np.concatenate([encode(v[i : i + ROWS * 8]).astype(np.float32) for i in range(0, len(v), ROWS * 8)])
    q, x = vectors(a["v"]), vectors(b["v"])
    floor_q, floor_x = np.full(len(q), -np.inf, np.float32), np.full(len(x), -np.inf, np.float32)
    for step in (1, -1):
        rows, keys, at, back = _ordered(*(np.array([t[::step] for t in df["v"].fillna("")], object) for df in (a, b)))
        _floor(q, x, rows, keys, at, ka, floor_q)
        _floor(x, q, keys, rows, back, kb, floor_x)
    basis = np.linalg.eigh((x.T @ x).astype(np.float64))[1][:, ::-1].astype(np.float32)
    m, (high, wide) = max(1, q.shape[1] * 3 // 8), TILE
    left, right = _split(q, basis, m, high), _split(x, basis, m, wide)
    least_q, least_x = (np.append(f - SLACK, np.full(len(side) - len(f), np.inf)).astype(np.float32) for f, side in ((floor_q, left), (floor_x, right)))
    names_a, names_b = (df["id"].to_numpy() for df in (a, b))
    rank_a, rank_b = (np.argsort(np.argsort(ids, kind="stable")) for ids in (names_a, names_b))
    bound, hit, hit_x = np.empty(TILE, np.float32), np.empty(TILE, bool), np.empty(TILE, bool)
    some_q, some_x = np.empty((ROWS, q.shape[1]), np.float32), np.empty((ROWS, q.shape[1]), np.float32)
    there, back, waiting = [], [], 0
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def reduced(parts: list, turn: bool) -> list:
        i, j, s = (np.concatenate(c) for c in zip(nothing, *parts, strict=True))
        keep = _best(j, rank_a[i], s, kb) if turn else _best(i, rank_b[j], s, ka)
        return [(i[keep], j[keep], s[keep])]

    for lo in range(0, len(left), high):
        part = []
        for at in range(0, len(right), wide):
            np.matmul(left[lo : lo + high], right[at : at + wide].T, out=bound)
            np.greater_equal(bound, least_q[lo : lo + high, None], out=hit)
            np.greater_equal(bound, least_x[at : at + wide], out=hit_x)
            np.logical_or(hit, hit_x, out=hit)
            eight = np.flatnonzero(hit.reshape(-1).view(np.uint64))
            word, byte = np.nonzero(hit.reshape(-1, 8)[eight])
            i, j = np.divmod(eight[word] * 8 + byte, wide)
            i, j = i + lo, j + at
            inside = (i < len(q)) & (j < len(x))
            i, j = i[inside], j[inside]
            for of in range(0, len(i), ROWS):
                r, c = i[of : of + ROWS], j[of : of + ROWS]
                cos = np.einsum("ij,ij->i", np.take(q, r, axis=0, out=some_q[: len(r)], mode="clip"), np.take(x, c, axis=0, out=some_x[: len(r)], mode="clip"))
                near = (cos >= least_q[r]) | (cos >= least_x[c])
                r, c = r[near], c[near]
                part.append((r, c, np.round(np.einsum("ij,ij->i", q[r].astype(np.float64), x[c].astype(np.float64)), 6)))
        if part:
            there += reduced(part, False)
            back += part
            waiting += sum(len(p[0]) for p in part)
            if waiting > 1 << 18:
                back, waiting = reduced(back, True), 0
                _, j, s = back[0]
                full = np.bincount(j, minlength=len(x)) == min(kb, len(q))
                worst = np.full(len(x), np.inf)
                np.minimum.at(worst, j, s)
                least_x[: len(x)][full] = np.maximum(least_x[: len(x)], worst.astype(np.float32) - SLACK)[full]
    out = []
    for parts, turn in ((there, False), (reduced(back, True), True)):
        i, j, s = (np.concatenate(c) for c in zip(nothing, *parts, strict=True))
        out.append(pd.DataFrame({"s1": names_a[i], "rec": names_b[j], "cos": s, "back": turn}))
    return pd.concat(out)


def mutual(s1: DataFrame, records: DataFrame, kf: int, kr: int, encode: Encode) -> DataFrame:
    """s1, rec, cos, rf, rr: `knn` of texts when every row of either side asks: a pair of blocks is met once for both ways."""
    kind, spark = dict(s1.dtypes)["id"], s1.sparkSession
    size = lambda df, n: df.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / MUTUAL).cast("int").alias(n))
    counts = size(s1, "qbs").join(size(records, "kbs"), "country")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["country", "qb", "kb"]
    # blocks are few and long: so many tasks that two seldom share one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    side = lambda df, q, k: df.join(counts, "country").withColumn("qb", q).withColumn("kb", k).select(*by, "id", "v").toDF(*by, "id", "v").repartition(tasks, *by).groupBy(*by)

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _mutual(a, b, kf, kr, encode) if len(a) and len(b) else pd.DataFrame({"s1": a["id"][:0], "rec": b["id"][:0], "cos": pd.Series([], dtype=float), "back": pd.Series([], dtype=bool)})

    found = written(side(s1, place("qbs"), each("kbs")).cogroup(side(records, each("qbs"), place("kbs"))).applyInPandas(search, f"s1 {kind}, rec {kind}, cos double, back boolean"), "near")
    ranked = lambda back, q, key, k: found.where(F.col("back") == back).withColumn("_r", F.row_number().over(Window.partitionBy(q).orderBy(F.desc("cos"), key)) - 1).where(F.col("_r") < k)
    none = F.lit(None).cast("int")
    ways = ranked(False, "s1", "rec", kf).select("s1", "rec", "cos", F.col("_r").alias("rf"), none.alias("rr")).union(ranked(True, "rec", "s1", kr).select("s1", "rec", "cos", none.alias("rf"), F.col("_r").alias("rr")))
    return ways.groupBy("s1", "rec").agg(F.max("cos").alias("cos"), F.min("rf").alias("rf"), F.min("rr").alias("rr"))


def candidates(views: dict[str, DataFrame], kf: dict[str, int], kr: dict[str, int]) -> DataFrame:
    """The union over views of pairs within each view's ranks, with every view's columns; absent ranks are ABSENT."""
    kept = {t: v.where((F.col("rf") < kf[t]) | (F.col("rr") < kr[t])) for t, v in views.items()}
    out = full_join_views(kept, ["s1", "rec"], ["cos", "rf", "rr"])
    return out.na.fill(ABSENT, [f"{c}_{t}" for t in views for c in ("rf", "rr")])


def acronym(core):
    return F.array_join(F.transform(F.filter(F.split(core, " "), lambda t: t != ""), lambda t: F.substring(t, 1, 1)), "")


def key_blocks(norm: DataFrame, cap: int = 20, least: int = 3) -> DataFrame:
    """s1, rec of one country that share a key: an S1's acronym and a record's core, or an S1's core and a record's domain; keys that occur over cap times on a side are left out."""
    bare = F.replace(F.col("core"), F.lit(" "), F.lit(""))
    one, other = norm.where("src = 1"), norm.where("src > 1")
    out = None
    for mine, theirs in ((acronym(F.col("core")), bare), (bare, F.col("dom"))):
        a = cap_keys(one.select("country", mine.alias("k"), F.col("entity_id").alias("s1")).where(F.length("k") >= least), ["country", "k"], cap)
        b = cap_keys(other.select("country", theirs.alias("k"), F.col("entity_id").alias("rec")).where(F.length("k") >= least), ["country", "k"], cap)
        pairs = a.join(b, ["country", "k"]).select("s1", "rec")
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def add_key_blocks(union: DataFrame, blocks: DataFrame) -> DataFrame:
    """The views' union with the pairs of key blocks: kb is 1 for those."""
    ranks = [c for c in union.columns if c.startswith(("rf_", "rr_"))]
    return union.join(blocks.withColumn("kb", F.lit(1)), ["s1", "rec"], "full").na.fill(ABSENT, ranks).na.fill(0, ["kb"])


def pair_cosines(pairs: DataFrame, vectors: DataFrame, name: str = "cos") -> DataFrame:
    """The inner product of both sides' vectors (id, v) for each pair."""
    left, right = vectors.select(F.col("id").alias("s1"), F.col("v").alias("_a")), vectors.select(F.col("id").alias("rec"), F.col("v").alias("_b"))
    return pairs.join(left, "s1", "left").join(right, "rec", "left").withColumn(name, dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def text_cosine(encode: Encode):
    """The inner product, in double precision, of what encode makes of two texts; a batch's texts are encoded once."""

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        places, texts = pd.factorize(pd.concat([a, b], ignore_index=True))
        v = encode(pd.Series(texts)).astype(np.float64)
        return pd.Series(np.einsum("ij,ij->i", v[places[: len(a)]], v[places[len(a) :]]))

    cosine.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(cosine, "double")


def prune_keep(scored: DataFrame, threshold: float, cap: int = 15, score: str = "ps") -> DataFrame:
    """Pairs at or over the threshold and within an S1's cap best."""
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc_nulls_last(score), "rec"))
    return scored.withColumn("ps_rank", rank).where((F.col(score) >= threshold) & (F.col("ps_rank") <= cap))


PRUNE_THRESHOLDS = (0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0001)


def prune_curve(scored: DataFrame, truth: DataFrame, s1: DataFrame, score: str = "ps", thresholds=PRUNE_THRESHOLDS) -> DataFrame:
    """threshold, recall of all true pairs, candidates per S1."""
    marked = scored.join(truth.withColumn("_y", F.lit(1)), ["s1", "rec"], "left").select(F.col(score).alias("x"), F.coalesce("_y", F.lit(0)).alias("_y"))
    sums = marked.agg(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.sum(F.when(F.col("x") >= t, F.col("_y"))), F.lit(0)).alias("hit"), F.count_if(F.col("x") >= t).alias("n")).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = sums.select(F.inline(F.array(*sums.columns)))
    return rows.join(F.broadcast(truth.agg(F.count(F.lit(1)).alias("nt")))).join(F.broadcast(s1.agg(F.count(F.lit(1)).alias("ns")))).select("threshold", (F.col("hit") / F.col("nt")).alias("recall"), (F.col("n") / F.col("ns")).alias("per_s1"))


def choose_threshold(curve: DataFrame, recall: float = 0.998) -> float:
    rows = sorted(curve.collect(), key=lambda r: -r.threshold)
    return next((r.threshold for r in rows if r.recall >= recall), rows[-1].threshold)


def view_text(norm: DataFrame, field: str = "combined", prefix: str = "") -> DataFrame:
    text = {"combined": F.concat_ws(" | ", "name_n", "addr_n"), "name": F.col("name_n"), "addr": F.col("addr_n")}[field]
    return norm.select(F.col("entity_id").alias("id"), "country", F.concat(F.lit(prefix), text).alias("text"))


class NgramEncoder:
    """An offline stand-in for a learned encoder: hashed character n-grams, weighted by inverse document frequency, to unit length."""

    def __init__(self, dim: int = 256, n: tuple[int, ...] = (2, 3, 4)):
        self.dim, self.n, self.idf = dim, n, np.ones(dim, np.float32)

    def _counts(self, texts: pd.Series) -> np.ndarray:
        """(texts, dim) numbers of n-grams of UTF-8 bytes, a space before and after each text."""
        data = [f" {t} ".encode() for t in texts]
        size = np.array([len(d) for d in data], np.int64)
        code = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        row, end = np.repeat(np.arange(len(data)), size), np.repeat(np.cumsum(size), size)
        out = np.zeros(len(data) * self.dim)
        for n in self.n:
            m = max(0, len(code) - n + 1)
            gram = np.full(m, n, np.uint64)
            for k in range(n):
                gram = gram << np.uint64(8) | code[k : k + m]
            gram = (gram ^ gram >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
            slot = ((gram ^ gram >> np.uint64(32)) % np.uint64(self.dim)).astype(np.int64)
            inside = np.arange(m) + n <= end[:m]
            out += np.bincount(row[:m][inside] * self.dim + slot[inside], minlength=len(out))
        return out.reshape(-1, self.dim)

    def fit(self, texts: DataFrame) -> NgramEncoder:
        def seen(batches):
            for b in batches:
                yield pd.DataFrame({"slot": np.arange(self.dim), "n": (self._counts(b["text"]) > 0).sum(0)})

        n = texts.count()
        for r in texts.select("text").mapInPandas(seen, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            self.idf[r.slot] = np.log1p(n / max(r.n, 1))
        return self

    def encode(self, texts: pd.Series) -> np.ndarray:
        x = (self._counts(texts) * self.idf).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def transform(self, texts: DataFrame) -> DataFrame:
        def encode(batches):
            for b in batches:
                yield b.drop(columns="text").assign(v=list(self.encode(b["text"])))

        kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "text")
        return texts.mapInPandas(encode, f"{kinds}, v array<float>")
