"""Toxicity by a classifier chain over hashed words and byte n-grams.

The categories are predicted in order; the log odds of the earlier ones are inputs of the later
linear models. In training those inputs are out-of-fold predictions, so a later model sees the
earlier ones as they will be on new text. Each model is a logistic regression on the presence of
the hashed features that tell the category best in the training sample.

The chain is fitted on at most `most_train` labelled documents (those of least hash of their id,
none of over `most_chars` characters), in one task; prediction reads every text whole. Null and
empty texts get the models' intercepts and are never rejected. Without labels, or with one class
alone, a category is its training share (0 without any). Rows that repeat a doc_id are each
scored; labels that disagree on an id count as positive if any does. Other columns are kept by
`reject` and dropped by `score`. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordvec import LOWER, U64, chunks, utf8, words

BUCKET_BITS = 20
GRAMS = (4, 6)
#: Features for each category, their least document count, folds, steps and ridge of the regressions.
FEATURES, LEAST_DOCS, FOLDS, STEPS, RIDGE = 1024, 4, 3, 300, 0.5
#: The chain's order and what makes a label positive.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def _buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the rows that begin at `at`, and the row of each."""
    low = LOWER[data - 0].astype(U64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = np.repeat(at[1:], np.diff(at))
    found, of = [], []
    shift = U64(64 - BUCKET_BITS)
    for n in GRAMS:
        if len(low) < n:
            continue
        m = len(low) - n + 1
        x = low[:m].copy()
        for k in range(1, n):
            x |= low[k : k + m] << U64(8 * k)
        x = (x * U64(0x9E3779B97F4A7C15)) ^ U64(n * 0x1000003)
        x *= U64(0xD6E8FEB86659FD93)
        inside = np.arange(m) + n <= end[:m]
        found.append((x >> shift)[inside])
        of.append(row[:m][inside])
    h, start = words(data, at)
    found.append((h * U64(0xA0761D6478BD642F)) >> shift)
    of.append(np.repeat(np.arange(len(at) - 1), np.diff(start)))
    return np.concatenate(found).astype(np.int32), np.concatenate(of)


def _rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        if at[-1] <= 1 << 22:
            yield lo, hi, *_buckets(data[offsets[lo] : offsets[hi]], at)
            continue
        for k in range(0, int(at[-1]), 1 << 22):  # a very long text by overlapping pieces; what is seen twice counts once
            piece = data[offsets[lo] + k : min(offsets[lo] + k + (1 << 22) + 64, offsets[hi])]
            yield lo, hi, *_buckets(piece, np.array([0, len(piece)]))


class Linear:
    """A logistic regression on binary features and a few numbers."""

    def __init__(self, share: float):
        self.share, self.weights, self.bias = share, None, 0.0

    @staticmethod
    def fit(row, col, n_rows, n_cols, extra, y) -> Linear:
        out = Linear(float(y.mean()) if len(y) else 0.0)
        if not 0 < out.share < 1:
            return out
        n_extra = extra.shape[1]
        w, b = np.zeros(n_cols + n_extra), np.log(out.share / (1 - out.share))
        size = np.bincount(col, minlength=n_cols).astype(float)
        scale = 1 / (0.25 * np.concatenate([size * 6, (extra**2).sum(0) * 6]) + RIDGE)
        momentum, shift = np.zeros_like(w), 0.0
        for _ in range(STEPS):
            z = np.bincount(row, weights=w[col], minlength=n_rows) + b
            if n_extra:
                z += extra @ w[n_cols:]
            miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            grad = np.bincount(col, weights=miss[row], minlength=n_cols)
            grad = np.concatenate([grad, extra.T @ miss]) + RIDGE * w
            momentum, shift = 0.9 * momentum - grad * scale, 0.9 * shift - miss.sum() / (0.25 * n_rows * 6)
            w, b = w + momentum, b + shift
        out.weights, out.bias = w, b
        return out

    def log_odds(self, row, col, n_rows, extra) -> np.ndarray:
        if self.weights is None:
            p = min(max(self.share, 1e-9), 1 - 1e-9)
            return np.full(n_rows, np.log(p / (1 - p)))
        n_cols = len(self.weights) - extra.shape[1]
        return np.bincount(row, weights=self.weights[col], minlength=n_rows) + extra @ self.weights[n_cols:] + self.bias


class Chain:
    def __init__(self, names: list[str]):
        self.names, self.models, self.column = names, [], np.full(1 << BUCKET_BITS, -1, np.int32)

    def features(self, bucket: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs of the features in use."""
        col = self.column[bucket]
        used = col >= 0
        pair = np.unique(of[used].astype(np.int64) << 32 | col[used])
        return pair >> 32, pair & 0xFFFFFFFF

    def predict(self, row: np.ndarray, col: np.ndarray, n_rows: int) -> np.ndarray:
        odds = np.zeros((n_rows, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.log_odds(row, col, n_rows, odds), -30, 30)])
        return odds


def fit_chain(texts: pa.Array, labels: np.ndarray, names: list[str]) -> Chain:
    """labels: a row for each text, a column for each category, 1, 0 or -1 where it has none."""
    chain = Chain(names)
    n = len(texts)
    docs = np.zeros((len(names), 2, 1 << BUCKET_BITS), np.int32)
    for lo, hi, bucket, of in _rows(texts):
        pair = np.unique(of.astype(np.int64) << 32 | bucket)
        r, f = (pair >> 32) + lo, pair & 0xFFFFFFFF
        for c in range(len(names)):
            for v in (0, 1):
                docs[c, v] += np.bincount(f[labels[r, c] == v], minlength=1 << BUCKET_BITS).astype(np.int32)
    used = set()
    for c in range(len(names)):
        no, yes = docs[c].astype(float)
        n_no, n_yes = max(1, (labels[:, c] == 0).sum()), max(1, (labels[:, c] == 1).sum())
        p, q = yes / n_yes, no / n_no
        mean = (yes + no) / (n_yes + n_no)
        score = np.where(yes + no >= LEAST_DOCS, (p - q) ** 2 / np.maximum(mean * (1 - mean), 1e-12), 0)
        best = np.argsort(-score, kind="stable")[:FEATURES]
        used |= set(best[score[best] > 0].tolist())
    chain.column[sorted(used)] = np.arange(len(used), dtype=np.int32)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, _, bucket, of in _rows(texts):
        r, f = chain.features(bucket, of)
        rows.append(r + lo)
        cols.append(f)
    pair = np.unique(np.concatenate(rows) << 32 | np.concatenate(cols))
    row, col = pair >> 32, pair & 0xFFFFFFFF
    fold = np.arange(n) % FOLDS
    odds = np.zeros((n, 0))
    for c in range(len(names)):
        known = labels[:, c] >= 0

        def fitted(of_rows, c=c, odds=odds):
            new = np.cumsum(of_rows) - 1
            keep = of_rows[row]
            return Linear.fit(new[row[keep]], col[keep], int(of_rows.sum()), len(used), odds[of_rows], labels[of_rows, c].astype(float))

        chain.models.append(fitted(known))
        if c + 1 < len(names):
            ahead = np.zeros(n)
            for k in range(FOLDS):
                ahead[fold == k] = fitted(known & (fold != k)).log_odds(row, col, n, odds)[fold == k]
            odds = np.column_stack([odds, np.clip(ahead, -30, 30)])
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, most_train: int = 16_000, most_chars: int = 200_000) -> Chain:
    """A chain from labelled documents, fitted in one task on a bounded sample."""
    names = [c[0] for c in categories]
    label = lambda c: F.max((F.col(c[1]) == c[2]).cast("int")).alias(c[0])
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[label(c) for c in categories])
    place = F.xxhash64("doc_id")
    n = known.count()
    if n > most_train:
        known = known.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * most_train / n))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= most_chars)
    sample = text.join(known, "doc_id").groupBy("doc_id").agg(F.first("text", True).alias("text"), *[F.first(c).alias(c) for c in names])

    def fit(batches):
        rows = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), *[(c, pa.int32()) for c in names]]))
        table = np.column_stack([rows[c].fill_null(-1).to_numpy() for c in names]).astype(np.int64).reshape(-1, len(names))
        texts = rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_chain(texts, table, names))], pa.binary())], ["chain"])

    ordered = sample.select("text", *[F.col(c).cast("int") for c in names], "doc_id").repartition(1).sortWithinPartitions("doc_id").drop("doc_id")
    found = ordered.mapInArrow(fit, "chain binary").collect()
    return pickle.loads(bytes(found[0].chain)) if found else fit_chain(pa.array([], pa.string()), np.zeros((0, len(names)), np.int64), names)


def score(docs: DataFrame, chain: Chain, *keep: str) -> DataFrame:
    """doc_id, p_<category> for each category of the chain; with the columns of `keep` before."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in keep]]
    rows = docs.select(*columns, F.col("text").cast("string").alias("text to score"))
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.names]])
    names = schema.names

    def predict(batches):
        chain = shared.value
        for batch in batches:
            pairs = [np.zeros(0, np.int64)]
            for lo, _, bucket, of in _rows(batch.column(batch.num_columns - 1)):
                r, c = chain.features(bucket, of)
                pairs.append((r + lo) << 32 | c)
            pair = np.unique(np.concatenate(pairs))
            odds = chain.predict(pair >> 32, pair & 0xFFFFFFFF, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(1 / (1 + np.exp(-odds[:, k]))) for k in range(len(chain.names))]], names)

    return rows.mapInArrow(predict, schema)


def is_toxic(threshold: float = 0.5) -> Column:
    return F.col("p_toxic") >= threshold


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic for each row of docs."""
    out = score(docs.withColumn("_blank", F.length(F.coalesce(F.col("text"), F.lit(""))) == 0), learn(docs, labels, **options), "_blank")
    return out.withColumn("toxic", is_toxic(threshold) & ~F.col("_blank")).drop("_blank")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that are not toxic, with their columns."""
    chain = learn(docs, labels, **options)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    kept = score(whole, chain, "row").where(~is_toxic(threshold) | (F.length(F.coalesce("row.text", F.lit(""))) == 0))
    return kept.select("row.*")
