"""Benchmark passages in documents, by spaced seeds.

A seed is a fixed mask over a few consecutive tokens, some of which it ignores, so a replaced
token under an ignored place leaves its hash as it was. Hashes of the documents' tokens under
every mask join those of the benchmark's items; each hit is then verified in place: it counts
if some `window` consecutive tokens of the item around it agree with the document's in at least
`percent` of their places. Everything is a DataFrame operation, and texts are read once and
never shuffled: a hit carries the few token hashes that its check needs. A bitmap of the
benchmark's tokens, of fixed size, spares most positions the hashing; a fuller one only passes
more. The items' seeds are broadcast up to `most_broadcast` of them and shuffled beyond.

Tokens are runs of letters and digits, lower-cased. Null texts have none. Items of fewer tokens
than a mask spans are too short to tell and match nothing; items shorter than the window are
compared whole. Rows that repeat a doc_id are one document, as are items of one item_id. Other
columns are ignored. Without documents or items the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks of one span and weight; 1 keeps the token, 0 ignores it.
MASKS = ("110110011", "101101101", "111010011")
SPAN = len(MASKS[0])
SPLIT = r"[^\p{L}\p{N}]+"
BITMAP_WORDS = 4096


def token_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w))


def _kept(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def _passing(h: Column, mask: str, known: Column | None) -> Column:
    """Positions whose kept tokens are all known; without `known`, every position."""
    at = F.sequence(F.lit(0), F.size(h) - SPAN)

    def every(i):
        test = F.lit(True)
        for k in _kept(mask):
            test = test & F.get(known, i + k)
        return test

    return at if known is None else F.filter(at, every)


def _seed_at(h: Column, n: int, mask: str, near: int):
    def seed(i):
        key = F.xxhash64(F.lit(n), *[F.get(h, i + k) for k in _kept(mask)])
        left = F.least(i, F.lit(near))
        return F.struct(key.alias("seed"), left.alias("left"), F.slice(h, i - left + 1, left + SPAN + near).alias("around"))

    return seed


def _seeds(h: Column, near: int, known: Column | None = None) -> Column:
    """An array of the seeds of every mask and position, each with the token hashes around it."""
    made = [F.transform(_passing(h, mask, known), _seed_at(h, n, mask, near)) for n, mask in enumerate(MASKS)]
    return F.when(F.size(h) >= SPAN, F.concat(*made))


def _agreement() -> Column:
    """For each place that both neighbourhoods of a hit have, 1 if the tokens agree."""
    back = F.least("left", "item_left")
    ahead = F.least(F.size("around") - F.col("left"), F.size("item_around") - F.col("item_left"))
    return F.transform(F.sequence(-back, ahead - 1), lambda k: (F.get("around", F.col("left") + k) == F.get("item_around", F.col("item_left") + k)).cast("int"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 20, percent: int = 80, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, item_id, n_hits: seeds of the item found and verified in the document, for each pair that has any."""
    spark = docs.sparkSession
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text").cast("string")).alias("h")).where(F.size("h") >= SPAN)
    seeds = item.select("item_id", F.least(F.size("h"), F.lit(window)).alias("need"), F.inline(_seeds(F.col("h"), window)))
    seeds = seeds.select("item_id", "need", "seed", F.col("left").alias("item_left"), F.col("around").alias("item_around")).distinct()
    tokens = item.select(F.explode("h").alias("t")).select(F.expr(f"shiftright(t, 6) & {BITMAP_WORDS - 1}").cast("int").alias("word"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("bit"))
    words = dict(tuple(r) for r in tokens.groupBy("word").agg(F.bit_or("bit")).collect())
    bitmap = F.lit(",".join(str(words.get(k, 0)) for k in range(BITMAP_WORDS)))
    bitmap = F.split(bitmap, ",").cast("array<bigint>")
    known = lambda t: F.getbit(F.get(bitmap, F.shiftright(t, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")), t.bitwiseAND(F.lit(63)).cast("int")) == 1
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1" and seeds.count() <= most_broadcast:
        seeds = F.broadcast(seeds)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_hashes(F.col("text").cast("string")).alias("h"))
    # the bitmap stands in the plan once: each copy of it would be in all of the driver's descriptions of the plan
    text = text.where(F.size("h") >= SPAN).withColumn("known", F.transform("h", known))
    found = text.select("doc_id", F.inline(_seeds(F.col("h"), window, F.col("known"))))
    hits = found.join(seeds, "seed").select("doc_id", "item_id", "need", _agreement().alias("same"))
    hits = hits.withColumn("total", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    dense = F.exists(F.sequence(F.lit(0), F.size("same") - F.col("need")), lambda s: F.aggregate(F.slice("same", s + 1, F.col("need")), F.lit(0), lambda a, x: a + x) * 100 >= F.col("need") * percent)
    enough = (F.size("same") >= F.col("need")) & (F.col("total") * 100 >= F.col("need") * percent) & ((F.col("total") == F.size("same")) | dense)
    return hits.where(enough).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, of any id or none, whose text holds no passage of the benchmark, with their columns."""
    keyed = docs.withColumn("row key", F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("long")))
    found = leaks(keyed.select(F.col("row key").alias("doc_id"), "text"), benchmark, **options)
    return keyed.join(found.select(F.col("doc_id").alias("row key")).distinct(), "row key", "left_anti").drop("row key")


def leaks_sql(docs: str = "documents", items: str = "benchmark", window: int = 20, percent: int = 80) -> str:
    """The same result as SQL for DuckDB, over the tokens themselves."""
    pos = "unnest(range(0, len(w) - {s} + 1))".format(s=SPAN)
    keys = " UNION ALL ".join("SELECT *, {n} AS m, [{k}] AS seed FROM {{t}}".format(n=n, k=", ".join(f"w[p + {k + 1}]" for k in _kept(mask))) for n, mask in enumerate(MASKS))
    return f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{SPLIT}'), lambda x: x <> '') AS w FROM {docs}),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '{SPLIT}'), lambda x: x <> '') AS w FROM {items}),
dp AS (SELECT doc_id, w, {pos} AS p FROM d WHERE len(w) >= {SPAN}), bp AS (SELECT item_id, w, {pos} AS p FROM b WHERE len(w) >= {SPAN}),
dk AS ({keys.format(t='dp')}), bk AS ({keys.format(t='bp')}),
hit AS (SELECT doc_id, item_id, dk.m, dk.p AS p, bk.p AS q, dk.w AS w, bk.w AS v, least({window}, len(bk.w)) AS need FROM dk JOIN bk ON dk.m = bk.m AND dk.seed = bk.seed),
s AS (SELECT *, list_transform(range(-least(p, q, {window}), least(len(w) - p, len(v) - q, {SPAN + window})), lambda k: CAST(w[p + k + 1] = v[q + k + 1] AS INTEGER)) AS same FROM hit),
ok AS (SELECT * FROM s WHERE len(same) >= need AND list_max(list_transform(range(0, len(same) - need + 1), lambda a: list_sum(same[a + 1:a + need]))) * 100 >= need * {percent})
SELECT doc_id, item_id, count(*) AS n_hits FROM ok GROUP BY ALL"""
