"""Dictionaries learned from true pairs, and pseudo-labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.normalize import is_native
from kinfold.functions.similarity import kernel
from kinfold.operators.relational import sample
from kinfold.operators.windows import competitor

SUPPORT = {"name_tok": 3, "addr_comp": 20, "addr_tok": 20}
SHARE = 0.6


def _numeric(c):
    return c.rlike("[0-9]")


def evidence(pairs: DataFrame) -> DataFrame:
    """country, kind, variant, canonical from pairs with tokens of both names (t1, t2, native2: flags) and address components (c1, c2)."""
    aligned = pairs.where((F.size("t1") == F.size("t2")) & F.exists("native2", lambda x: x))
    names = aligned.select("country", F.explode(F.arrays_zip("t1", "t2", "native2")).alias("x")).where("x.native2")
    names = names.select("country", F.lit("name_tok").alias("kind"), F.col("x.t2").alias("variant"), F.col("x.t1").alias("canonical"))
    only = pairs.select("country", F.array_except("c2", "c1").alias("v"), F.array_except("c1", "c2").alias("w")).where("size(v) = 1 and size(w) = 1").select("country", F.get("v", F.lit(0)).alias("variant"), F.get("w", F.lit(0)).alias("canonical"))
    comps = only.where(~_numeric(F.col("variant")) & ~_numeric(F.col("canonical")))
    comps = comps.select("country", F.lit("addr_comp").alias("kind"), "variant", "canonical")
    tokens = only.select("country", F.split("variant", " ").alias("v"), F.split("canonical", " ").alias("w")).where("size(v) = size(w)")
    tokens = tokens.select("country", F.filter(F.arrays_zip("v", "w"), lambda x: x["v"] != x["w"]).alias("d")).where("size(d) = 1").select("country", F.lit("addr_tok").alias("kind"), F.get("d", F.lit(0))["v"].alias("variant"), F.get("d", F.lit(0))["w"].alias("canonical"))
    tokens = tokens.where(~_numeric(F.col("variant")) & ~_numeric(F.col("canonical")))
    return names.union(comps).union(tokens)


def true_sides(norm: DataFrame, truth: DataFrame) -> DataFrame:
    """evidence's input for true pairs: an S1's clean words, a record's words as they are written, both address components."""
    comps = F.transform(F.split("addr_n", ","), lambda t: F.trim(t))
    one = norm.select(F.col("entity_id").alias("s1"), "country", F.split("name_n", " ").alias("t1"), comps.alias("c1"))
    raw = F.split(F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))), " ")
    two = norm.select(F.col("entity_id").alias("rec"), raw.alias("t2"), comps.alias("c2"))
    return truth.select("s1", "rec").join(one, "s1").join(two, "rec").withColumn("native2", F.transform("t2", is_native))


def mine(norm: DataFrame, truth: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """country, kind, variant, canonical: dictionaries from the true pairs, of S1s in group A alone if splits are given."""
    if splits is not None:
        truth = truth.join(splits.where("grp = 'A'").select("s1"), "s1", "left_semi")
    return resolve_chains(select(counts(evidence(true_sides(norm, truth)))).persist())


def counts(found: DataFrame) -> DataFrame:
    return found.where("variant <> canonical and variant <> ''").groupBy("country", "kind", "variant", "canonical").agg(F.count(F.lit(1)).alias("n"))


def is_subsequence(short, long):
    """Whether the characters of short occur in long in order."""
    left = F.aggregate(F.split(long, ""), short, lambda rest, c: F.when((F.length(rest) > 0) & (F.substring(rest, 1, 1) == c), rest.substr(F.lit(2), F.length(rest))).otherwise(rest))
    return F.length(left) == 0


def plausible(kind, variant, canonical):
    close = (F.substring(variant, 1, 1) == F.substring(canonical, 1, 1)) & is_subsequence(variant, canonical) | (kernel("ratio")(variant, canonical) >= 75)
    return (kind == "name_tok") | (F.length(variant) >= 2) & ((kind == "addr_comp") | close)


def select(counted: DataFrame, support: dict[str, int] | None = None, share: float = SHARE) -> DataFrame:
    """The most frequent canonical form of each variant (ties to the lesser) if it has support, share and plausibility."""
    support = support or SUPPORT
    w = Window.partitionBy("country", "kind", "variant")
    least = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in support.items()])
    best = counted.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("n"), "canonical")), "_all": F.sum("n").over(w)}).where("_r = 1")
    best = best.where((F.col("n") >= least) & (F.col("n") >= share * F.col("_all")) & (F.col("canonical") != ""))
    return best.where(plausible(F.col("kind"), F.col("variant"), F.col("canonical"))).select("country", "kind", "variant", "canonical", "n")


def resolve_chains(maps: DataFrame, most: int = 16) -> DataFrame:
    """variant to where its chain ends; a chain that turns in a circle stops before the variant it began with. Self joins, one for each step, until nothing moves."""
    step = maps.select("country", "kind", F.col("variant").alias("target"), F.col("canonical").alias("next"))
    now = maps.select("country", "kind", "variant", F.col("canonical").alias("target"), F.array("variant").alias("seen"))
    for _ in range(most):
        joined = now.join(step, ["country", "kind", "target"], "left")
        go = F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next"))
        if joined.where(go).isEmpty():
            break
        now = joined.select("country", "kind", "variant", F.when(go, F.col("next")).otherwise(F.col("target")).alias("target"), F.when(go, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"))
    return now.where("variant <> target").select("country", "kind", "variant", F.col("target").alias("canonical"))


def pseudo_pairs(pairs: DataFrame, unlabelled: list[str], p: float = 0.98, margin: float = 0.9, neg: float = 0.02, n: int = 150_000, seed: int = 0) -> DataFrame:
    """s1, rec, y: confident positives and negatives of countries without labels, up to n of each."""
    own = competitor(pairs.where(F.col("country").isin(unlabelled)))
    yes = own.where((F.col("p") >= p) & (F.col("margin") >= margin)).select("s1", "rec", F.lit(1).alias("y"))
    no = own.where(F.col("p") <= neg).select("s1", "rec", F.lit(0).alias("y"))
    return sample(yes, n, seed, "s1", "rec").union(sample(no, n, seed, "s1", "rec"))


def optional_components(sides: DataFrame, least: int = 500, share: float = 0.5, shared_top: int = 200, most_ratio: float = 70.0) -> DataFrame:
    """country, comp: address components that often stand on one side alone, hold no digits and resemble no component that both sides have. sides: country, c1, c2 arrays."""
    parts = sides.select("country", F.explode(F.array_union("c1", "c2")).alias("comp"), "c1", "c2").select("country", "comp", (F.array_contains("c1", F.col("comp")) & F.array_contains("c2", F.col("comp"))).cast("int").alias("both"))
    stats = parts.groupBy("country", "comp").agg(F.count(F.lit(1)).alias("n"), F.avg("both").alias("both"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "comp"))
    shared = stats.where((F.col("n") >= least) & (F.col("both") >= share)).withColumn("_r", rank).where(F.col("_r") <= shared_top).select("country", F.col("comp").alias("other"))
    single = stats.where((F.col("n") >= least) & (1 - F.col("both") >= share) & ~_numeric(F.col("comp")))
    near = single.join(shared, "country", "left").groupBy("country", "comp").agg(F.max(F.coalesce(kernel("ratio")("comp", "other"), F.lit(0.0))).alias("r"))
    return near.where(F.col("r") < most_ratio).select("country", "comp")
