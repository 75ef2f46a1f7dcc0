"""Features of candidate pairs. Missing is null throughout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.similarity import MANY, kernel
from kinfold.operators.windows import context

OOV, OOV_DIFF, NONE_DIFF = 12.0, 16.0, 20.0


def words(c):
    """Tokens of a text; commas are spaces."""
    return F.filter(F.split(F.translate(c, ",", " "), " "), lambda t: t != "")


def idf_table(norm: DataFrame, field: str) -> DataFrame:
    """token, idf: the log of records over occurrences (repeats within a record count)."""
    tokens = norm.select(F.explode(words(F.col(field))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return tokens.join(F.broadcast(norm.agg(F.count(F.lit(1)).alias("all")))).select("token", F.ln(F.col("all") / F.col("n")).alias("idf"))


def weighed(norm: DataFrame, idf: DataFrame, field: str) -> DataFrame:
    """norm with {field}_w: its distinct tokens with their idf, null if unknown. A record's tokens are joined once, not those of each of its pairs."""
    each = norm.select("entity_id", F.explode(F.array_distinct(words(F.col(field)))).alias("token")).join(idf, "token", "left")
    lists = each.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias(f"{field}_w"))
    none = F.array().cast("array<struct<token:string,idf:double>>")
    return norm.join(lists, "entity_id", "left").withColumn(f"{field}_w", F.coalesce(f"{field}_w", none))


def idf_overlap(pairs: DataFrame, a: str, b: str, prefix: str) -> DataFrame:
    """pairs with Jaccard and coverage by summed idf, and the rarest shared token; null if a side has no token. a and b: weighed tokens."""
    weights = lambda c: F.transform(c, lambda t: F.coalesce(t["idf"], F.lit(OOV)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, w: s + w)
    names = F.transform(b, lambda t: t["token"])
    shared = weights(F.filter(a, lambda t: F.array_contains(names, t["token"])))
    work = pairs.withColumns({"_has": (F.size(a) > 0) & (F.size(b) > 0), "_i": shared, "_a": total(weights(F.col(a))), "_b": total(weights(F.col(b)))})
    work = work.withColumns({"_m": F.coalesce(F.array_max("_i"), F.lit(0.0)), "_i": total(F.col("_i"))})
    out = {f"{prefix}_idf_jac": F.try_divide(F.col("_i"), F.col("_a") + F.col("_b") - F.col("_i")), f"{prefix}_idf_cov": F.try_divide(F.col("_i"), F.col("_a")), f"{prefix}_idf_max": F.col("_m")}
    return work.select(*pairs.columns, *[F.when(F.col("_has"), v).alias(k) for k, v in out.items()])


def _unlike(least: float):
    """The tokens of a text, repeats included, that equal none of another's and resemble none; a batch's token pairs are scored once."""

    def unlike(mine: pd.Series, others: pd.Series) -> pd.Series:
        found = lambda t: tuple(w for w in t.replace(",", " ").split(" ") if w) if t is not None else ()
        sides = [(found(x), found(y)) for x, y in zip(mine, others, strict=True)]
        each = {s: [t for t in s[0] if t not in s[1]] for s in set(sides)}
        pairs = list({(t, o) for s, left in each.items() for t in left for o in s[1]})
        near = {p for p, r in zip(pairs, MANY["ratio"]([t for t, _ in pairs], [o for _, o in pairs]), strict=True) if r >= least}
        left = {s: [t for t in left if not any((t, o) in near for o in s[1])] for s, left in each.items()}
        return pd.Series([left[s] for s in sides], dtype=object)

    unlike.__annotations__ = {"mine": pd.Series, "others": pd.Series, "return": pd.Series}
    return F.pandas_udf(unlike, "array<string>")


def token_differences(pairs: DataFrame, a: str = "core", b: str = "core", least: float = 75.0) -> DataFrame:
    """pairs with td_extra_n, td_miss_n and their least idf: tokens of a side that equal none of the other and resemble none; null if a side has no token. Texts {a}_a and {b}_b, weighed in {a}_w_a and {b}_w_b."""
    one, other, w1, w2 = f"{a}_a", f"{b}_b", f"{a}_w_a", f"{b}_w_b"
    work = pairs.withColumns({"_extra": _unlike(least)(other, one), "_miss": _unlike(least)(one, other)})
    has = (F.size(w1) > 0) & (F.size(w2) > 0)
    rarity = lambda w, gone: F.coalesce(F.array_min(F.transform(F.filter(w, lambda t: F.array_contains(gone, t["token"])), lambda t: F.coalesce(t["idf"], F.lit(OOV_DIFF)))), F.lit(NONE_DIFF))
    out = {"td_extra_n": F.size("_extra").cast("long"), "td_miss_n": F.size("_miss").cast("long"), "td_extra_minidf": rarity(w2, F.col("_extra")), "td_miss_minidf": rarity(w1, F.col("_miss"))}
    return work.select(*pairs.columns, *[F.when(has, v).alias(k) for k, v in out.items()])


def number_features(pairs: DataFrame, a: str = "nums_a", b: str = "nums_b") -> DataFrame:
    """How the numbers of both sides agree; all null if a side has none."""
    x, y = words(F.col(a)), words(F.col(b))
    work = pairs.withColumns({"_x": x, "_y": y})
    has = (F.size("_x") > 0) & (F.size("_y") > 0)
    fx, fy = F.get("_x", F.lit(0)), F.get("_y", F.lit(0))
    ends = lambda p, q: F.endswith(p, q) | F.endswith(q, p)
    both, either = F.size(F.array_intersect("_x", "_y")), F.size(F.array_union("_x", "_y"))
    number = lambda t: F.substring(t, 1, 12).cast("bigint")
    out = {
        "num_first_eq": (fx == fy).cast("int"),
        "num_jac": both / either,
        "num_inter": both,
        "num_first_suffix": ends(fx, fy).cast("int"),
        "num_a_in_b": (F.size(F.array_except("_x", "_y")) == 0).cast("int"),
        "td_num_absdiff": F.when(fx == fy, 0.0).otherwise(F.log1p(F.abs(number(fx) - number(fy)).cast("double"))),
        "td_num_samelen": (F.length(fx) == F.length(fy)).cast("int"),
        "td_num_affix": (ends(fx, fy) | F.startswith(fx, fy) | F.startswith(fy, fx)).cast("int"),
        "td_num_unexpl": F.size(F.filter("_y", lambda t: ~F.exists("_x", lambda u: F.endswith(u, t) | F.endswith(t, u)))),
    }
    return work.select(*pairs.columns, *[F.when(has, v).alias(k) for k, v in out.items()])


def legal_features(pairs: DataFrame) -> DataFrame:
    a, b = F.col("legal_a"), F.col("legal_b")
    return pairs.withColumns({"legal_eq": (a == b).cast("int"), "legal_both_empty": ((a == "") & (b == "")).cast("int"), "legal_b_empty": (b == "").cast("int"), "phone_eq": F.when((F.col("phone_a") != "") & (F.col("phone_b") != ""), (F.col("phone_a") == F.col("phone_b")).cast("int"))})


def with_sides(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Both sides' normal forms, suffixed _a and _b."""
    fields = ["name_n", "core", "alt", "legal", "dom", "addr_n", "nums", "phone", "name", "name_native", "addr_native", "src", *[c for c in norm.columns if c.endswith("_w")]]
    side = lambda key, s: norm.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in fields])
    return pairs.join(side("s1", "a"), "s1").join(side("rec", "b"), "rec")


def string_features(sides: DataFrame) -> DataFrame:
    """Similarities of names, cores, domains and addresses."""
    k = {n: kernel(n) for n in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "partial_token_set_ratio", "jaro_winkler")}
    c = F.col
    bare = lambda x: F.replace(c(x), F.lit(" "), F.lit(""))
    addr = lambda v: F.when(c("addr_n_b") != "", v)
    dom = lambda v: F.when(c("dom_b") != "", v)
    a = bare("core_a")
    return sides.withColumns(
        {
            "n_ratio": k["ratio"]("name_n_a", "name_n_b"), "n_partial": k["partial_ratio"]("name_n_a", "name_n_b"), "n_tset": k["token_set_ratio"]("name_n_a", "name_n_b"), "n_tsort": k["token_sort_ratio"]("name_n_a", "name_n_b"), "n_jw": k["jaro_winkler"]("name_n_a", "name_n_b"),
            "c_ratio": k["ratio"]("core_a", "core_b"), "c_tset": k["token_set_ratio"]("core_a", "core_b"), "c_partial": k["partial_ratio"]("core_a", "core_b"), "c_jw": k["jaro_winkler"]("core_a", "core_b"),
            "raw_ratio": k["ratio"](F.lower("name_a"), F.lower("name_b")), "alt_ratio": F.when(c("alt_b") != "", k["ratio"]("core_a", "alt_b")), "ns_ratio": k["ratio"](a, bare("core_b")),
            "dom_ratio": dom(k["ratio"](a, "dom_b")), "dom_partial": dom(k["partial_ratio"](a, "dom_b")), "dom_prefix": dom((F.startswith(a, c("dom_b")) | F.startswith(c("dom_b"), a)).cast("int")),
            "a_ratio": addr(k["ratio"]("addr_n_a", "addr_n_b")), "a_tset": addr(k["token_set_ratio"]("addr_n_a", "addr_n_b")), "a_tsort": addr(k["token_sort_ratio"]("addr_n_a", "addr_n_b")), "a_partial": addr(k["partial_ratio"]("addr_n_a", "addr_n_b")), "a_pset": addr(k["partial_token_set_ratio"]("addr_n_a", "addr_n_b")),
            "addr_b_empty": (c("addr_n_b") == "").cast("int"), "b_name_native": c("name_native_b").cast("int"), "b_addr_native": c("addr_native_b").cast("int"), "b_src": c("src_b").cast("int"),
            "len_a": F.length("name_n_a"), "len_b": F.length("name_n_b"), "alen_a": F.length("addr_n_a"), "alen_b": F.length("addr_n_b"),
        }
    )


def pair_features(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Every pair feature, and the context of n_ratio and a_tset, and of the cosines cos and cos_c where pairs have them."""
    for field in ("core", "addr_n"):
        norm = weighed(norm, idf_table(norm, field), field)
    sides = with_sides(pairs, norm)
    flat = token_differences(idf_overlap(idf_overlap(legal_features(number_features(string_features(sides))), "core_w_a", "core_w_b", "c"), "addr_n_w_a", "addr_n_w_b", "a"))
    flat = flat.select("s1", "rec", *[c for c in flat.columns if c not in ("s1", "rec") and (c not in sides.columns or c in pairs.columns)])
    for score, prefix in (("n_ratio", "kn"), ("a_tset", "ka"), ("cos", "kc"), ("cos_c", "kcc")):
        flat = context(flat, score, prefix) if score in flat.columns else flat
    return flat


def feature_table(feat: DataFrame, scores: dict[str, DataFrame], groups: DataFrame | None = None) -> DataFrame:
    """feat with further scores of the pairs (s1, rec, score), each with its context, and with features of the group."""
    for name, df in scores.items():
        feat = context(feat.join(df.select("s1", "rec", F.col("score").alias(name)), ["s1", "rec"], "left"), name, f"x_{name}")
    return feat if groups is None else feat.join(groups, ["s1", "rec"], "left")


def cheap_features(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """The few similarities that pruning uses, each with rank and gap on both sides."""
    sides = with_sides(pairs, norm)
    scored = sides.withColumns(
        {"q_tsort": kernel("token_sort_ratio")("name_n_a", "name_n_b"), "q_core": kernel("ratio")("core_a", "core_b"), "q_addr": kernel("token_set_ratio")("addr_n_a", "addr_n_b"), "q_nums": kernel("token_set_ratio")("nums_a", "nums_b"), "q_addr_empty": (F.col("addr_n_b") == "").cast("int"), "q_src": F.col("src_b").cast("int")}
    )
    out = scored.select(*pairs.columns, "q_tsort", "q_core", "q_addr", "q_nums", "q_addr_empty", "q_src")
    for score in ("q_tsort", "q_core", "q_addr", "q_nums", "cos"):
        out = context(out, score, score) if score in out.columns else out
    return out
