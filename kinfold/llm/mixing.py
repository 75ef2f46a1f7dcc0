"""Mixing sources to target weights by temperature.

A source's weight is its share of the corpus's words to the power of an exponent, normalised.
The exponent is bisected between 0 (equal weights) and 1 (the corpus as it is): to the largest
one whose entropy reaches a target, and from there up to the smallest one under which no source
is repeated more often than a limit allows. Each step of the bisection evaluates a grid of
exponents in one aggregation over the table of sources, which never leaves the cluster.

The weights are then realised as a budget of words for each source. A source is dealt into
blocks by keyed hashes, and each block into parts; an epoch is a keyed permutation of its
blocks. Whole epochs are taken while the budget lasts, and of the last one the blocks that still
fit; of the first block that doesn't, the parts that fit, in a permutation of their own. So the
budget is met to about 1 / BLOCKS**2 of a source, or a document.

Documents are aggregated to the sums of their cells (source, block, part) and, once these are
decided, read a second time; they are never shuffled. The decisions of up to MOST_BROADCAST
sources (some kilobytes each) are broadcast; those of more meet the documents by a salted join.

The result has a row for each document taken, with its columns, the `weight` of its source, its
`words`, and `copies`: how often it is taken. Documents without words cost nothing and are taken
in each whole epoch of their source, at least once if the source has no words at all. A null
source is a source. Rows that repeat a doc_id are dealt together and each counted; those without
an id are dealt by their text. Columns of docs named words, weight or copies are replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.scratch import Scratch

BLOCKS = 256
#: Bisection: a grid of so many exponents for each aggregation, so many times.
GRID, STEPS = 32, 4
MOST_BROADCAST, SALTS = 2_000, 64


def n_words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _curve(sources: DataFrame, low: float, high: float) -> list:
    """For a grid of exponents: entropy in nats, and the most that a source is repeated under a budget of the whole corpus."""
    grid = F.array(*[F.lit(low + (high - low) * k / (GRID - 1)) for k in range(GRID)])
    each = sources.where("words > 0").select("words", F.explode(grid).alias("e"))
    sums = each.groupBy("e").agg(F.sum(F.pow("words", "e")).alias("z"), F.sum("words").alias("total"))
    p = F.pow("words", "e") / F.col("z")
    found = each.join(F.broadcast(sums), "e").groupBy("e").agg(F.sum(-p * F.log(p)).alias("entropy"), F.max(p * F.col("total") / F.col("words")).alias("repeats"))
    return sorted(found.collect(), key=lambda r: r.e)


def exponent(sources: DataFrame, target_entropy: float | None, most_repeats: float | None, budget_share: float) -> float:
    """sources: words of each. The exponent that meets the entropy, as far as the limit of repetitions allows."""

    def last(ok, low=0.0, high=1.0):
        """The largest exponent for which ok holds on the grid, ok being true up to it."""
        for _ in range(STEPS):
            rows = _curve(sources, low, high)
            good = [r.e for r in rows if ok(r)]
            if len(good) in (0, len(rows)):
                return low if not good else high
            low, high = good[-1], next(r.e for r in rows if not ok(r))
        return low

    e = 1.0 if target_entropy is None else last(lambda r: r.entropy >= target_entropy)
    if most_repeats is None:
        return e
    over = last(lambda r: r.repeats * budget_share > most_repeats * (1 + 1e-9))
    return max(e, over + (1.0 / (GRID - 1) ** STEPS if over > 0 else 0.0))


def weights(sources: DataFrame, entropy_gain: float = 0.5, most_repeats: float | None = 4.0, budget_share: float = 1.0) -> DataFrame:
    """sources (source, words) with weight and budget: the target is the corpus's entropy plus entropy_gain of what equal weights would add."""
    ends = {r.e: r.entropy for r in _curve(sources, 0.0, 1.0)}
    if not ends:
        return sources.withColumn("weight", F.lit(0.0)).withColumn("budget", F.lit(0.0))
    target = ends[1.0] + entropy_gain * (ends[0.0] - ends[1.0])
    e = exponent(sources, target, most_repeats, budget_share)
    whole = sources.where("words > 0").agg(F.sum(F.pow("words", F.lit(e))).alias("z"), F.sum("words").alias("total"))
    w = F.when(F.col("words") > 0, F.pow("words", F.lit(e)) / F.col("z")).otherwise(0.0)
    return sources.join(F.broadcast(whole)).select("source", "words", w.alias("weight"), (w * F.col("total") * budget_share).alias("budget"))


def _taken(blocks: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Of (by, block, words, left), in a permuted order: whether a block fits into `left`, and what is left for the first that doesn't."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *by, "block"), "block")
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    state = blocks.withColumn("upto", upto)
    cut = F.lag("upto", 1, 0).over(order)
    return state.withColumn("whole", F.col("upto") <= F.col("left")).withColumn("rest", F.when((F.col("upto") > F.col("left")) & (cut <= F.col("left")), F.col("left") - cut))


def _dealt(docs: DataFrame, seed: int) -> DataFrame:
    """docs with words and `its cell`: source (its name after =, empty for null), block, part."""
    text = F.col("text").cast("string")
    place = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), text)), F.lit(BLOCKS)).cast("int")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.drop("words", "weight", "copies").withColumns({"words": n_words(text), "its cell": F.struct(source.alias("source"), place(1).alias("block"), place(2).alias("part"))})


def decide(cells: DataFrame, scratch: Scratch, entropy_gain: float, most_repeats: float | None, budget_share: float, seed: int) -> DataFrame:
    """source, weight, epochs, and the blocks and parts of blocks that are taken once more; cells: source, block, part, words."""
    sources = scratch.save(cells.groupBy("source").agg(F.sum("words").alias("words")))
    plan = scratch.save(weights(sources, entropy_gain, most_repeats, budget_share))
    epochs = F.when(F.col("words") > 0, F.floor(F.col("budget") / F.col("words") + 1e-9)).otherwise(1)
    plan = plan.select("source", "weight", epochs.cast("long").alias("epochs"), F.when(F.col("words") > 0, F.greatest(F.col("budget") - epochs * F.col("words"), F.lit(0.0))).otherwise(0.0).alias("left"))
    blocks = cells.groupBy("source", "block").agg(F.sum("words").alias("words")).where("words > 0").join(plan.select("source", "left"), "source")
    outer = scratch.save(_taken(blocks, ["source"], seed).select("source", "block", "whole", "rest"))
    edge = outer.where("rest is not null").select("source", "block", F.col("rest").alias("left"))
    parts = cells.where("words > 0").join(edge, ["source", "block"]).select("source", F.col("block").alias("outer"), F.col("part").alias("block"), "words", "left")
    inner = _taken(parts, ["source", "outer"], seed + 1).where("whole")
    picked = outer.where("whole").select("source", "block", F.lit(-1).alias("part")).union(inner.select("source", F.col("outer").alias("block"), F.col("block").alias("part")))
    more = picked.groupBy("source").agg(F.collect_set(F.when(F.col("part") < 0, F.col("block"))).alias("blocks"), F.collect_set(F.when(F.col("part") >= 0, F.struct("block", "part"))).alias("parts"))
    return plan.drop("left").join(more, "source", "left")


def mix(docs: DataFrame, entropy_gain: float = 0.5, most_repeats: float | None = 4.0, budget_share: float = 1.0, seed: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of docs that are taken, with their columns, words, weight and copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    dealt = _dealt(docs, seed)
    cells = scratch.save(dealt.groupBy("its cell").agg(F.sum("words").alias("words")).select("its cell.*", "words"))
    plan = scratch.save(decide(cells, scratch, entropy_gain, most_repeats, budget_share, seed).select(F.struct("*").alias("its plan")))
    on = F.col("its cell.source") == F.col("its plan.source")
    if plan.count() <= most_broadcast:
        found = dealt.join(F.broadcast(plan), on)
    else:
        salted = plan.withColumn("plan salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = (F.col("its cell.block") * BLOCKS + F.col("its cell.part")) % SALTS
        found = dealt.withColumn("its salt", salt).join(salted, on & (F.col("its salt") == F.col("plan salt"))).drop("its salt", "plan salt")
    block, part = F.col("its cell.block"), F.struct(F.col("its cell.block").alias("block"), F.col("its cell.part").alias("part"))
    extra = F.coalesce(F.array_contains("its plan.blocks", block) | F.array_contains("its plan.parts", part), F.lit(False)) & (F.col("words") > 0)
    found = found.withColumns({"weight": F.col("its plan.weight"), "copies": F.col("its plan.epochs") + extra.cast("long")})
    return found.where("copies > 0").drop("its cell", "its plan")
