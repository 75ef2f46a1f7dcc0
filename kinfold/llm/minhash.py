"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys (each a few minhashes) are computed once; every pair of one
half key from either collection is a table key. 2 * halves * rows minhashes thus serve
halves**2 tables, about the square root of what separate tables would take. Candidates are
checked on the full shingle sets, so no link is wrong; a pair at the threshold s is missed with
probability of about 2 * (1 - s**rows)**halves.

Exact copies collapse to one class before any key is formed. A half key that one class alone has
can't be part of a shared table key, so only repeated ones are combined. Classes that share
buckets, directly or through others, form a region; each text of a region is read once more and
meets the others in one task, which intersects all their sets as a product of incidence
matrices and returns no more links than join what it found linked. A region of more than BLOCK
classes or WEIGHT shingles is dealt into blocks. Each is first united for itself; then some
members of each component meet, which unites the parts that the blocks have of one group; last
the blocks meet in pairs, but not where both hold members of the region's main component alone.

Null or wordless texts have no shingles and link with nothing. Texts of fewer words than a
shingle are one shingle. Rows that repeat a doc_id each take the component of their own text.
Rows without a doc_id get no component. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.graph import components, forest
from kinfold.llm.scratch import Scratch
from kinfold.llm.wordvec import U64, chunks, mix, shingles, utf8, words

#: Classes and shingles of a block; a task holds two blocks at most.
BLOCK, WEIGHT = 1024, 1_000_000
#: Shingles that fewer classes of a task share are counted pair by pair, others by matrix products of so many columns.
RARE, COLUMNS = 8, 2048


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7919))
    a = rng.integers(0, 2**63, (2, n), dtype=np.int64).astype(U64) * U64(2) + U64(1)
    return a[0][:, None], a[1][:, None]


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        h, at = words(data, offsets[lo : hi + 1])
        for i in range(hi - lo):
            yield shingles(h[at[i] : at[i + 1]], size)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch], size: int, halves: int, rows: int) -> Iterator[pa.RecordBatch]:
    n = 2 * halves
    xor, times = _seeds(n * rows)
    for batch in batches:
        count, digest, keys = np.zeros(len(batch), np.int64), [], np.zeros((len(batch), n), np.int64)
        for i, s in enumerate(_sets(batch.column(1), size)):
            count[i] = len(s)
            digest.append(_digest(s))
            if len(s):
                least = np.full(len(xor), 2**64 - 1, U64)
                for k in range(0, len(s), 4096):
                    np.minimum(least, ((s[None, k : k + 4096] ^ xor) * times).min(1), out=least)
                key = least[::rows]
                for r in range(1, rows):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + least[r::rows])
                keys[i] = key.view(np.int64)
        half = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), n).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(digest, pa.binary()), half], ["doc_id", "n_shingles", "digest", "half"])


def signatures(docs: DataFrame, words_each: int, halves: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the shingle set, and the half keys of both collections."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        functools.partial(_sign, size=words_each, halves=halves, rows=rows), "doc_id long, n_shingles long, digest binary, half array<long>"
    )


def shared_buckets(classes: DataFrame, halves: int, scratch: Scratch) -> DataFrame:
    """(rep, least rep of a bucket) for the buckets of several classes."""
    each = classes.select("rep", F.posexplode("half").alias("i", "h")).select("rep", "i", F.xxhash64("i", "h").alias("h"))
    several = lambda rows, key: rows.groupBy(key).agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select(key, "least")
    repeated = each.join(several(each, "h").select("h"), "h", "left_semi")
    side = lambda first: F.collect_list(F.when((F.col("i") < halves) == first, F.col("h")))
    both = repeated.groupBy("rep").agg(side(True).alias("a"), side(False).alias("b"))
    keys = scratch.save(both).select("rep", F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key"))
    return keys.join(several(keys, "key"), "key").where("rep <> least").select("rep", "least").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, or of left."""
    sets, a = left + (right or []), len(left)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((a, len(right) if right is not None else a))
    order = np.argsort(col, kind="stable")
    own, df_of = own[order], np.repeat(df, df)
    pairs = []
    for k in range(2, min(RARE, len(sets) + 1)):
        rows = own[df_of == k].reshape(-1, k)
        for x in range(k):
            for y in range(x + 1, k):
                pairs.append(rows[:, x] * len(sets) + rows[:, y])  # the first is the lesser, as the order is stable
    if pairs:
        at, n = np.unique(np.concatenate(pairs), return_counts=True)
        x, y = at // len(sets), at % len(sets)
        if right is None:
            out[x, y] = out[y, x] = n
        else:
            across = (x < a) & (y >= a)
            out[x[across], y[across] - a] = n[across]
    often = df_of >= RARE
    own, col = own[often], np.repeat(np.arange((df >= RARE).sum()), df[df >= RARE])
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, (k, k + COLUMNS))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[own[lo:hi], col[lo:hi] - k] = 1
        out += x[:a] @ (x[:a] if right is None else x[a:]).T
    if right is None:
        np.fill_diagonal(out, [len(s) for s in left])
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], node: np.ndarray, label: np.ndarray, first: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, lesser node) that join whatever is linked among different labels; of `first` sets with the others, if given."""
    every = np.arange(len(sets))
    a, b = (every, every) if first is None else (every[first], every[~first])
    both = overlaps([sets[i] for i in a], None if first is None else [sets[i] for i in b])
    n = np.array([len(s) for s in sets])
    link = (den * both >= num * (n[a][:, None] + n[b][None] - both)) & (both > 0) & (label[a][:, None] != label[b][None])
    x, y = np.nonzero(link)
    u, v = forest(node[a[x]], node[b[y]])
    return u[u != v], v[u != v]


def _verify(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of their group: (region, low, high, block, rep, label, digest, text)."""
    held: list[tuple] = []
    seen: set[tuple] = set()
    now = None

    def made():
        u = v = np.zeros(0, np.int64)
        block, node, label = (np.array([r[k] for r in held], np.int64) for k in range(3))
        first = block == now[1] if now[1] != now[2] else None
        if len(held) > 1 and (first is None or 0 < first.sum() < len(held)):
            u, v = linked([r[3] for r in held], node, label, first, num, den)
        held.clear()
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(7)), _sets(batch.column(7), size), strict=True)
        for *key, block, rep, label, digest, s in rows:
            if key != now and held:
                yield made()
            now = key
            # a repeated row counts once, and of several texts with one id the class's own
            if (rep, digest) not in seen and _digest(s) == digest:
                seen.add((rep, digest))
                held.append((block, rep, label, s.copy()))
    if held:
        yield made()


def _verified(rows: DataFrame, words_each: int, num: int, den: int) -> DataFrame:
    """(u, v): links within the groups (region, low, high)."""
    group = ["region", "low", "high"]
    dealt = rows.select(*group, "block", "rep", "label", "digest", "text").repartition(*group).sortWithinPartitions(*group, "rep")
    return dealt.mapInArrow(functools.partial(_verify, size=words_each, num=num, den=den), "u long, v long").distinct()


def _blocks(rows: DataFrame, block: int, weight: int) -> DataFrame:
    """region, blocks: how many its classes fill."""
    return rows.groupBy("region").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / weight)).cast("int").alias("blocks"))


def near_duplicates(docs: DataFrame, words_each: int = 5, num: int = 80, den: int = 100, halves: int = 16, rows: int = 4, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents whose shingle sets have den * intersection >= num * union are linked."""
    scratch = Scratch(docs.sparkSession, "minhash")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = scratch.save(signatures(text, words_each, halves, rows))
    classes = scratch.save(sig.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("half").alias("half")))
    region = components(shared_buckets(classes, halves, scratch), scratch).toDF("rep", "region")
    inside = classes.select("rep", "n", "digest").join(region, "rep")
    inside = inside.join(_blocks(inside, block, weight), "region").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    inside = scratch.save(text.join(inside, text.doc_id == inside.rep).drop("doc_id"))
    alone = inside.withColumns({"low": F.col("block"), "high": F.col("block"), "label": F.col("rep")})
    links = scratch.save(_verified(alone, words_each, num, den))
    labels = components(links, scratch)
    large = inside.where("blocks > 1")
    if not large.isEmpty():

        def labelled():
            known = labels.withColumnRenamed("node", "rep")
            return large.join(known, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")

        mark = F.xxhash64("rep", F.lit(1))
        few = labelled().groupBy("region", "block", "label").agg(F.count(F.lit(1)).alias("size"), F.array_distinct(F.array(F.min("rep"), F.min_by("rep", mark), F.max_by("rep", mark))).alias("some"))
        few = labelled().join(few.where("size > 1").select(F.explode("some").alias("rep")).distinct(), "rep", "left_semi")
        few = few.drop("blocks").join(_blocks(few, block, weight), "region").withColumn("low", F.pmod(mark, "blocks").cast("int")).withColumn("high", F.col("low"))
        links = scratch.save(links.union(_verified(few, words_each, num, den)))
        labels = components(links, scratch)
        main = labelled().groupBy("region", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("region").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
        # members of the main component have even blocks, which need not meet each other
        apart = labelled().join(main, "region").withColumn("block", 2 * F.col("block") + (F.col("label") != F.col("main")).cast("int"))
        apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), 2 * F.col("blocks") - 1))).where("shiftright(other, 1) <> shiftright(block, 1) and (block % 2 = 1 or other % 2 = 1)")
        apart = apart.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        links = scratch.save(links.union(_verified(apart, words_each, num, den)))
        labels = components(links, scratch)
    scratch.drop(inside)
    scratch.release()
    rep = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(rep, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each group of near duplicates, with its columns: that of the least doc_id (null last), then of the least text's hash.

    Rows tell apart by doc_id and text; those that agree in both are copies, of which the least
    row is kept. Rows without words are no one's copies and stay, repeated ones too.
    """
    names = ["row key", "row id"]
    keyed = docs.select("*", F.xxhash64(*[x for c in ("doc_id", "text") for x in (F.col(c), F.col(c).isNull())]).alias(names[0]), F.col("doc_id").cast("long").alias(names[1]))
    found = near_duplicates(keyed.select(F.col(names[0]).alias("doc_id"), "text"), **options).distinct()
    ids = keyed.groupBy(names[0]).agg(F.min(names[1]).alias(names[1]))
    order = F.struct(F.col(names[1]).isNull(), names[1], names[0])
    kept = found.join(ids, F.col("doc_id") == F.col(names[0])).groupBy("component_id").agg(F.min_by(names[0], order).alias("kept key"), F.min("n_shingles").alias("row shingles"))
    rows = keyed.join(kept.select("kept key", "row shingles"), F.col(names[0]) == F.col("kept key"))
    one = F.col("row shingles") > 0
    single = rows.where(one).groupBy(names[0]).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return rows.where(~one).select(docs.columns).union(single)
