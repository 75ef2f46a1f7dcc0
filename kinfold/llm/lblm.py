"""Language model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Words are lower-cased in ASCII and split at ASCII white space; a text ends with one more token.
Counts cover every training document: each task sums its own, the cluster sums those.

The modelled vocabulary grows with the corpus: the most frequent tokens, as many as the square
root of the training tokens (LEAST_WORDS to MOST_WORDS, a bound on the model's memory). They are
sorted by kind (first and last byte) and cut into about sqrt(vocabulary) classes of equal mass; the
tokens beyond fall into KINDS classes by kind. A token's probability is that of its class after
the context, times that of the word within its class after the context; a token beyond the
vocabulary has in its class the share of its count, smoothed by 0.1, with 0.1 more for the unseen
ones. So the probabilities of all tokens sum to one after any context.

The context vector is a linear mix of the CONTEXT previous tokens' vectors, each position with a
matrix of its own. Training contrasts a token's class with noise classes shared by a batch, and
the word with noise words of its class, both drawn from their shares. Documents are dealt into
chunks of about CHUNK_CHARS characters by hash of id and text, and a chunk is always trained in
the order of those hashes, so the model depends on the documents alone, not on how the table is
split. Every position of a document is a target once. All chunks start from a model of a bounded sample (WARM_ROWS documents of least hash, until
WARM_CHARS characters are read); each trains a copy, and the copies are averaged on the cluster.

To score, a chunk meets the counts of its own distinct rare tokens, never the whole table.
Softmaxes are exact, by matrix products over batches: one over the classes, one over the words of
each class for the tokens that fall in it.

Null texts are empty and hold the end alone. Rows are kept as they come, repeated ones too.
Other columns are ignored. An empty table gives an empty result; without training documents
every token is unseen and the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.scratch import Scratch
from kinfold.llm.wordvec import U64, chunks, utf8, words

LEAST_WORDS, MOST_WORDS, KINDS, DIM, CONTEXT = 256, 65_536, 64, 8, 3
BATCH, NOISE, WORD_NOISE, RATES = 8192, 32, 1, (0.1, 0.05)
WARM_ROWS, WARM_CHARS, CHUNK_CHARS = 8192, 8_000_000, 8_000_000
SMOOTH = 0.1
#: Weight of the neural model against the outputs' shares.
GAIN = 0.95
END = np.uint64(0x0123456789ABCDEF)


def tokens(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges, their token hashes with an end after each row, and where each row begins."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets, most):
        h, at = words(data, offsets[lo : hi + 1])
        rows = hi - lo
        out = np.empty(len(h) + rows, U64)
        start = at + np.arange(rows + 1)
        ends = start[1:] - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = h, END
        yield lo, hi, out, start


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sums, in runs of bounded size."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    size = 0
    for batch in batches:
        for _, _, h, _ in tokens(batch.column(0)):
            part = np.unique(h, return_counts=True)
            held.append(part)
            size += len(part[0])
        if size > 4_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 2_000_000:
                yield pa.RecordBatch.from_arrays([_signed(held[0][0]), pa.array(held[0][1])], ["token", "n"])
                held, size = [], 0
    if held:
        h, n = merged()
        yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], ["token", "n"])


class Outputs:
    """The vocabulary in order of classes, its masses, and the classes of all tokens."""

    def __init__(self, frequent: np.ndarray, count: np.ndarray, kind_mass: np.ndarray, total: int, kinds: int):
        order = np.lexsort((-count, (frequent >> U64(58)).astype(np.int64)))
        self.total, self.kinds, self.words = total, kinds, len(frequent)
        self.mass = np.concatenate([count[order] + SMOOTH, kind_mass])
        n = max(1, int(np.sqrt(self.words))) if self.words else 0
        upto = np.cumsum(self.mass[: self.words])
        # a class ends where its share of the mass is full
        self.of_word = np.minimum((upto - self.mass[: self.words] / 2) / upto[-1] * n, n - 1).astype(np.int32) if n else np.zeros(0, np.int32)
        self.of_word = np.unique(self.of_word, return_inverse=True)[1].astype(np.int32)
        self.n_word_classes = int(self.of_word[-1]) + 1 if n else 0
        self.classes = self.n_word_classes + KINDS
        self.edge = np.searchsorted(self.of_word, np.arange(self.n_word_classes + 1))
        self.class_of = np.concatenate([self.of_word, self.n_word_classes + np.arange(KINDS, dtype=np.int32)])
        self.class_mass = np.bincount(self.class_of, weights=self.mass, minlength=self.classes)
        whole = self.mass.sum()
        self.share = self.mass / whole if whole else np.full(len(self.mass), 1 / len(self.mass))
        self.class_share = np.bincount(self.class_of, weights=self.share, minlength=self.classes)
        by = np.argsort(frequent[order])
        self.sorted, self.place, self.count = frequent[order][by], by.astype(np.int32), count[order]

    @property
    def size(self) -> int:
        return self.words + KINDS

    def of(self, h: np.ndarray) -> np.ndarray:
        """Each token's output: its place in the vocabulary, or beyond it its kind."""
        out = self.words + (h >> U64(58)).astype(np.int32)
        if self.words:
            at = np.minimum(np.searchsorted(self.sorted, h), self.words - 1)
            out = np.where(self.sorted[at] == h, self.place[at], out)
        return out


class Model:
    """Vectors of contexts, classes and words, mixing matrices; biases are a last column."""

    def __init__(self, outputs: Outputs):
        rng = np.random.Generator(np.random.PCG64(17))
        self.outputs = outputs
        log = lambda x: np.log(np.maximum(x, 1e-12))
        inside = outputs.share / np.maximum(outputs.class_share, 1e-30)[outputs.class_of]
        self.context = rng.normal(0, 0.1, (outputs.size + 1, DIM)).astype(np.float32)
        self.classes = np.column_stack([rng.normal(0, 0.1, (outputs.classes, DIM)), log(outputs.class_share)]).astype(np.float32)
        self.word = np.column_stack([rng.normal(0, 0.1, (outputs.words, DIM)), log(inside[: outputs.words])]).astype(np.float32)
        self.mixing = np.stack([np.eye(DIM) / (k + 1) for k in range(CONTEXT)]).astype(np.float32)
        self.squares = None

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.classes, self.word, self.mixing]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, values: np.ndarray) -> Model:
        at = 0
        for part in self.parts():
            part[...] = values[at : at + part.size].reshape(part.shape)
            at += part.size
        return self

    def predicted(self, contexts: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Context vectors with a last 1 for the bias."""
        tables = tables or self.tables()
        out = np.ones((len(contexts), DIM + 1), np.float32)
        out[:, :DIM] = tables[0][contexts[:, 0]]
        for k in range(1, CONTEXT):
            out[:, :DIM] += tables[k][contexts[:, k]]
        return out

    def tables(self) -> list[np.ndarray]:
        return [self.context @ m for m in self.mixing]

    def log_probabilities(self, contexts: np.ndarray, y: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural logarithms of the outputs' probabilities after their contexts."""
        o, q = self.outputs, self.predicted(contexts, tables)
        of = o.class_of[y]
        out = np.empty(len(y))
        for k in range(0, len(y), 2048):
            rows = slice(k, k + 2048)
            out[rows] = _log_softmax(q[rows] @ self.classes.T, of[rows])
        order = np.argsort(of.astype(np.uint16), kind="stable")  # there are few classes
        edges = np.searchsorted(of[order], np.arange(o.n_word_classes + 1))
        for c in np.flatnonzero(np.diff(edges)):
            lo, hi = o.edge[c], o.edge[c + 1]
            if hi - lo > 1:
                for k in range(edges[c], edges[c + 1], 2048):
                    rows = order[k : min(k + 2048, edges[c + 1])]
                    out[rows] += _log_softmax(q[rows] @ self.word[lo:hi].T, y[rows] - lo)
        return out

    def train(self, contexts: np.ndarray, targets: np.ndarray, rng, rate: float) -> None:
        """A pass of noise-contrastive estimation with steps by AdaGrad."""
        o = self.outputs
        if self.squares is None:
            self.squares = [np.full_like(t, 1e-6) for t in self.parts()]
        log_class = np.log(np.maximum(o.class_share, 1e-12) * NOISE).astype(np.float32)
        inside = np.log(np.maximum(o.share / np.maximum(o.class_share, 1e-30)[o.class_of], 1e-12) * WORD_NOISE).astype(np.float32)
        class_edges, upto = np.cumsum(o.class_share), np.concatenate([[0.0], np.cumsum(o.share[: o.words])])
        for k in range(0, len(targets), BATCH):
            ctx, y = contexts[k : k + BATCH], targets[k : k + BATCH]
            q = self.predicted(ctx)
            c = o.class_of[y]
            z = np.minimum(np.searchsorted(class_edges, rng.random(NOISE) * class_edges[-1]), o.classes - 1)
            up = _sigmoid(log_class[c] - (q * self.classes[c]).sum(1))
            down = _sigmoid(q @ self.classes[z].T - log_class[z])
            grad_q = up[:, None] * self.classes[c] - down @ self.classes[z]
            steps = [(1, np.concatenate([c, z]), np.concatenate([up[:, None] * q, -(down.T @ q)]))]
            if len(seen := np.flatnonzero(y < o.words)):
                qw, yw = q[seen], y[seen]
                low, high = upto[o.edge[c[seen]]], upto[o.edge[c[seen] + 1]]
                noise = np.searchsorted(upto, low[:, None] + rng.random((len(seen), WORD_NOISE)) * (high - low)[:, None], side="right") - 1
                noise = np.clip(noise, o.edge[c[seen]][:, None], o.edge[c[seen] + 1][:, None] - 1)
                up = _sigmoid(inside[yw] - (qw * self.word[yw]).sum(1))
                vectors = self.word[noise]
                down = _sigmoid(np.einsum("nd,nkd->nk", qw, vectors) - inside[noise])
                grad_q[seen] += up[:, None] * self.word[yw] - np.einsum("nk,nkd->nd", down, vectors)
                steps.append((2, np.concatenate([yw, noise.ravel()]), np.concatenate([up[:, None] * qw, -(down[:, :, None] * qw[:, None]).reshape(-1, DIM + 1)])))
            g = grad_q[:, :DIM]
            steps.append((0, ctx.T.ravel(), np.concatenate([g @ m.T for m in self.mixing])))
            mixing = np.stack([self.context[ctx[:, j]].T @ g for j in range(CONTEXT)]) / len(y)
            for part, rows, grad in steps:
                _step(self.parts()[part], self.squares[part], rows, grad / np.float32(len(y)), rate)
            self.squares[3] += mixing * mixing
            self.mixing += np.float32(rate) * mixing / np.sqrt(self.squares[3])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(z)), at]
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    return np.clip(own, -60, 60) - np.log(z.sum(1))


def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """An AdaGrad step for the rows that have a gradient; gradients of one row are summed."""
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")  # short keys are sorted by radix
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    at, g = rows[first], np.add.reduceat(g[order], first, axis=0)
    square = squares[at] + g * g
    squares[at] = square
    table[at] += np.float32(rate) * g / np.sqrt(square)


def _contexts(y: np.ndarray, start: np.ndarray, none: int) -> np.ndarray:
    """The CONTEXT outputs before each position; `none` before a row's first."""
    out = np.full((len(y), CONTEXT), none, np.int32)
    for k in range(1, CONTEXT + 1):
        out[k:, k - 1] = y[:-k] if len(y) > k else y[:0]
        for j in range(k):
            at = start[:-1] + j
            out[at[(at < start[1:])], k - 1] = none
    return out


def _table(docs: DataFrame, train: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("train", F.coalesce(train, F.lit(True)))
    return rows.withColumn("place", F.xxhash64("doc_id", "text"))


def _fit_outputs(counts: DataFrame) -> Outputs:
    kinds, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted, top = int(min(MOST_WORDS, max(LEAST_WORDS, total**0.5))), None
    if total:  # only tokens of about the needed count are sorted
        cell, held, least = F.floor(F.log2("n") * 16), 0, 0
        for r in sorted(counts.groupBy(cell.alias("cell")).count().collect(), key=lambda r: -r.cell):
            held, least = held + r["count"], r.cell
            if held >= wanted:
                break
        top = counts.where(cell >= least).orderBy(F.desc("n"), "token").limit(wanted).toPandas()
    frequent = top["token"].to_numpy(np.int64).view(U64) if total else np.zeros(0, U64)
    count = top["n"].to_numpy(np.int64) if total else np.zeros(0, np.int64)
    mass = np.full(KINDS, SMOOTH)
    for r in counts.groupBy(F.shiftrightunsigned("token", 58).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        mass[r.k] += r.n + SMOOTH * r.kinds
    np.subtract.at(mass, (frequent >> U64(58)).astype(np.int64), count + SMOOTH)
    return Outputs(frequent, count, np.maximum(mass, SMOOTH), int(total), int(kinds))


def _warmed(rows: DataFrame, outputs: Outputs, n: int) -> Model:
    model = Model(outputs)
    if not outputs.total:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def train(batches):
        model, rng, seen = shared.value, np.random.Generator(np.random.PCG64(100)), 0
        for batch in batches:
            for _, _, h, at in tokens(batch.column(0)):
                if seen < WARM_CHARS:
                    y = model.outputs.of(h)
                    model.train(_contexts(y, at, model.outputs.size), y, rng, RATES[0])
            seen += batch.column(0).nbytes
        yield pa.RecordBatch.from_arrays([pa.array([model.flat().tobytes()], pa.binary())], ["flat"])

    # rows by hash of id and text; copies of one row are one
    bits = 1 << 30
    few = rows.where("train").where(F.pmod(F.xxhash64("place"), F.lit(bits)) < int(bits * min(1.0, 2 * WARM_ROWS / max(n, 1))))
    sample = few.select("place", "text").distinct().orderBy("place").limit(WARM_ROWS).coalesce(1).select("text")
    found = sample.mapInArrow(train, "flat binary").collect()
    return model.load(np.frombuffer(found[0].flat, np.float32))


PARAMETERS = [f"x{k}" for k in range(DIM)]


def _trained(rows: DataFrame, warm: Model, scratch: Scratch) -> tuple[DataFrame, Model]:
    """The distinct tokens of each chunk beyond the vocabulary, and the average of the models that the chunks train."""
    shared = rows.sparkSession.sparkContext.broadcast(warm)
    nothing = lambda n, kind: pa.nulls(n, kind)
    names = ["chunk", "token", "w", *PARAMETERS]

    def learn(batches):
        warm = shared.value
        outputs, sums, weight = warm.outputs, None, 0
        now, model, rng, seen, held = None, None, None, 0, []

        def listed():
            rare = np.unique(np.concatenate(held)) if held else np.zeros(0, U64)
            n = len(rare)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, now, np.int32)), _signed(rare), nothing(n, pa.float64()), *[nothing(n, pa.float64())] * DIM], names)

        for batch in batches:
            of_row = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of_row)) + 1), len(of_row)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if of_row[a] != now:
                    if now is not None:
                        yield listed()
                        if seen:
                            sums, weight = (0 if sums is None else sums) + model.flat().astype(np.float64) * seen, weight + seen
                    now, seen, held = int(of_row[a]), 0, []
                    model, rng = Model(outputs).load(warm.flat()), np.random.Generator(np.random.PCG64(now))
                for lo, hi, h, at in tokens(batch.column(2).slice(a, b - a)):
                    y = outputs.of(h)
                    held.append(np.unique(h[y >= outputs.words]))
                    train = batch.column(1).slice(a + lo, hi - lo).to_numpy(zero_copy_only=False)
                    if train.any():
                        keep, size = np.repeat(train, np.diff(at)), np.diff(at)[train]
                        start = np.concatenate([[0], np.cumsum(size)])
                        y = y[keep]
                        model.train(_contexts(y, start, outputs.size), y, rng, RATES[1])
                        seen += len(y)
        if now is not None:
            yield listed()
            if seen:
                sums, weight = (0 if sums is None else sums) + model.flat().astype(np.float64) * seen, weight + seen
        if weight:
            x = np.resize(sums, (-(-len(sums) // DIM), DIM))
            n = len(x)
            yield pa.RecordBatch.from_arrays([nothing(n, pa.int32()), pa.array(np.arange(n)), pa.array(np.full(n, float(weight))), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(DIM)]], names)

    dealt = rows.select("chunk", "train", "text", "place", "doc_id").repartition("chunk").sortWithinPartitions("chunk", "place", "doc_id").select("chunk", "train", "text")
    found = scratch.save(dealt.mapInArrow(learn, "chunk int, token long, w double, " + ", ".join(f"{x} double" for x in PARAMETERS)))
    mean = [(F.sum(x) / F.sum("w")).alias(x) for x in PARAMETERS]
    flat = found.where("chunk is null").groupBy("token").agg(*mean).toPandas().sort_values("token")
    if len(flat):
        warm.load(flat[PARAMETERS].to_numpy(np.float32).ravel())
    return found.where("chunk is not null").select("chunk", "token"), warm


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.outputs, self.tables = model, model.outputs, model.tables()
        o = self.outputs
        self.whole = np.log10(o.total + SMOOTH * (o.kinds + 1))
        self.log_mass = np.log10(o.mass)

    def __call__(self, texts: pa.Array, known: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of each text; known: sorted rare tokens, and their counts."""
        o, n = self.outputs, len(texts)
        out = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
        for lo, hi, h, at in tokens(texts):
            y = o.of(h)
            c = np.zeros(len(h))
            rare = y >= o.words
            c[~rare] = o.count[y[~rare]]
            if len(known):
                r = h[rare]
                place = np.minimum(np.searchsorted(known, r), len(known) - 1)
                c[rare] = np.where(known[place] == r, count[place], 0)
            own = np.log10(c + SMOOTH)
            log_p = self.model.log_probabilities(_contexts(y, at, o.size), y, self.tables)
            log_p = np.log10(GAIN * np.exp(log_p) + (1 - GAIN) * o.share[y]) + np.where(rare, own - self.log_mass[y], 0)
            for part, value in zip(out[1:], ((c > 0).astype(np.int64), own - self.whole, log_p), strict=True):
                part[lo:hi] = np.add.reduceat(value, at[:-1])
            out[0][lo:hi] = np.diff(at)
        return out


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows in order of (chunk, is a document): a chunk's counts, then its documents."""
    score, now, held, known, count = _Scorer(model), None, [], None, None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if key[0, a] != now:
                now, held, known = key[0, a], [], None
            part = batch.slice(a, b - a)
            if not key[1, a]:
                held.append((part.column(2).to_numpy().view(U64), part.column(3).to_numpy()))
                continue
            if known is None:
                known, count = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, (U64, np.int64)[k]) for k in (0, 1))
                order = np.argsort(known)
                known, count, held = known[order], count[order], []
            yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), *map(pa.array, score(part.column(6), known, count))], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, train: Column, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the rows that train holds for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lblm")
    rows = _table(docs, train)
    counts = scratch.save(rows.where("train").select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    outputs = _fit_outputs(counts)
    size, n = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0)), F.count(F.lit(1))).first()
    rows = rows.withColumn("chunk", F.pmod("place", F.lit(max(1, -(-size // chunk_chars)))).cast("int"))
    asked, model = _trained(rows, _warmed(rows, outputs, n), scratch)
    known = asked.join(counts, "token").select("chunk", F.lit(0).alias("is_doc"), "token", "n")
    known = known.withColumns({"doc_id": F.lit(None).cast("long"), "train": F.lit(None).cast("boolean"), "text": F.lit(None).cast("string")})
    texts = rows.select("chunk", F.lit(1).alias("is_doc"), F.lit(0).cast("long").alias("token"), F.lit(0).cast("long").alias("n"), "doc_id", "train", "text")
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        return _score(batches, shared.value)

    both = known.union(texts).repartition("chunk").sortWithinPartitions("chunk", "is_doc")
    found = both.mapInArrow(scored, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(outputs.total)).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(parts: int = 10, remainder: int = 0) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts == remainder
