"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER symbols counts what follows them. The
probability of the next byte is its share in the longest context seen; a byte not seen there
costs an escape (as many as the context has followers, out of its count and them) and goes on
in the next shorter context, down to a uniform one. Statistics are frozen after learning, so a
code length is a sum over positions and is exact: it is looked up in sorted tables, one for each
language and order, of the contexts and symbols seen. The language with the shortest code wins.

Symbols are the 256 byte values, lower-cased. Learning covers all its rows; the counts are
summed over the cluster, and there is one for each run of ORDER + 1 bytes seen in a language.

Null texts and those without a letter are `und` with score 0, as is everything if nothing was
learned. The score is the winner's posterior under equal priors. Ties go to the lesser name.
Rows are kept as they come, repeated ones too. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordvec import LOWER, chunks, utf8

SYMBOLS, ORDER = 256, 3
ALPHABET = np.arange(SYMBOLS, dtype=np.uint8)
LETTER = re.compile(r"[^\W\d_]")


def _pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges, their bytes, and where each row begins."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets, most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _codes(data: np.ndarray, starts: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Each position's context and symbol as one number; a row begins after spaces."""
    s = symbol[LOWER[data]].astype(np.uint32)
    blank = np.uint32(symbol[32])
    code = s.copy()
    for k in range(1, ORDER + 1):
        back = np.empty_like(s)
        back[:k], back[k:] = blank, s[:-k]
        for j in range(k):
            at = starts + j
            back[at[at < len(s)]] = blank
        code += back * np.uint32(SYMBOLS**k)
    return code


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, of = np.unique(code, return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, of, n)
    return code, total


def _count(batches: Iterator[pa.RecordBatch], symbol: np.ndarray) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for lo, hi, data, at in _pieces(batch.column(0), 1 << 22):
            if not len(data):
                continue
            starts = at[:-1][at[:-1] < at[1:]]
            code = _codes(data, starts, symbol)
            of = np.repeat(np.arange(hi - lo), np.diff(at))
            for lang in set(langs[lo:hi]):
                parts = found.setdefault(lang, [])
                parts.append(np.unique(code[(langs[lo:hi] == lang)[of]], return_counts=True))
                # merged when the later parts outgrow the first, so that each code moves few times
                if sum(len(c) for c, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                    found[lang] = [_summed(parts)]
    for lang, parts in found.items():
        code, n = _summed(parts)
        for k in range(0, len(code), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[part]), pa.string()), pa.array(code[part].astype(np.int64)), pa.array(n[part])], ["lang", "code", "n"])


def _find(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted, non-empty keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


class Tree:
    """One language: for each order the bits of what was seen, and of an escape from each context."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.seen, self.escape = [], []
        for order in range(ORDER + 1):
            keys, n_key = _summed([(code.astype(np.int64) % SYMBOLS ** (order + 1), n)])
            contexts, of, kinds = np.unique(keys // SYMBOLS, return_inverse=True, return_counts=True)
            total = np.bincount(of, weights=n_key)
            self.seen.append((keys, -np.log2(n_key / (total + kinds)[of])))
            self.escape.append((contexts, -np.log2(kinds / (total + kinds))))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        codes, out, left = codes.astype(np.int64), np.zeros(len(codes)), np.arange(len(codes))
        for order in reversed(range(ORDER + 1)):
            keys, bits = self.seen[order]
            key = codes[left] % SYMBOLS ** (order + 1)
            at, found = _find(keys, key)
            out[left[found]] += bits[at[found]]
            left, key = left[~found], key[~found]
            contexts, bits = self.escape[order]
            at, found = _find(contexts, key // SYMBOLS)
            out[left[found]] += bits[at[found]]
        out[left] += np.log2(SYMBOLS)
        return out


class Table:
    """Code lengths by (codes, language)."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees

    def __getitem__(self, key: tuple[np.ndarray, int]) -> np.ndarray:
        codes, lang = key
        return self.trees[lang].bits(codes)

    def lengths(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each row in each language; a code that recurs is looked up once."""
        some, of = np.unique(codes, return_inverse=True)
        return np.stack([np.add.reduceat(tree.bits(some)[of], starts) for tree in self.trees], axis=1)


class Model:
    def __init__(self, langs: list[str], symbol: np.ndarray, codes: list[np.ndarray], counts: list[np.ndarray]):
        self.langs, self.symbol, self.codes, self.counts, self.trees = langs, symbol, codes, counts, None

    def __getstate__(self):
        return self.__dict__ | {"trees": None}

    def table(self) -> Table:
        """Built once in each process from the counts of what was seen."""
        if self.trees is None:
            self.trees = Table([Tree(code, n) for code, n in zip(self.codes, self.counts, strict=True)])
        return self.trees


def learn(docs: DataFrame, condition: Column) -> Model:
    """Trees from text and non-null lang of the rows that meet the condition."""
    rows = docs.where(condition & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null")

    def count(batches):
        return _count(batches, ALPHABET)

    total = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs, codes, counts = [], [], []
    for lang, part in total.groupby("lang"):
        langs.append(lang)
        codes.append(part["code"].to_numpy(np.uint32))
        counts.append(part["n"].to_numpy(np.int64))
    return Model(langs, ALPHABET, codes, counts)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pred, score = ["und"] * len(batch), np.zeros(len(batch))
        texts = batch.column(1)
        for lo, hi, data, at in _pieces(texts, 1 << 18):
            if not len(data) or not model.langs:
                continue
            filled = np.flatnonzero(at[:-1] < at[1:])
            starts = at[:-1][filled]
            bits = model.table().lengths(_codes(data, starts, model.symbol), starts)
            best = bits.argmin(1)
            odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for k, row in enumerate(filled):
                if LETTER.search(texts[lo + int(row)].as_py()):
                    pred[lo + row], score[lo + row] = model.langs[best[k]], 1 / odds[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        return _predict(batches, shared.value)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(parts: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts == remainder


def identify_held_out(docs: DataFrame, parts: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents held out are not learned from."""
    model = learn(docs, ~held_out(parts, remainder))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(held_out(parts, remainder), F.lit(False)).alias("held_out"), "lang_pred", "score")
