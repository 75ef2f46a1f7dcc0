"""Secrets in texts, found through a trigram index.

From each rule's expression a Boolean trigram query is derived. The index holds a posting for
each text and each trigram that some rule asks for; the postings of an alternative are
intersected, and the expressions run only over the texts that are left. Rules that demand no
trigram run over every text. Everything is a DataFrame operation.

Spans are [start, end) in code points, leftmost and not overlapping within a kind. Null texts
are empty; a null doc_id is an id. Rows are kept as they come: a repeated row is returned as often as it came. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.scratch import Scratch
from kinfold.llm.trigram import trigram_query


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A match counts if this group has as many characters at least.
    group: int = 0
    least: int = 0


# The formats of well-known secrets.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
EXTRA_RULES = (
    Rule("temporary", r"ASIA[A-Z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.%-]{1,64}:[^\s:/@\"']{3,128}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + EXTRA_RULES


def _found(text: Column, rule: Rule, kind: int) -> Column:
    """Matches in order: characters since the last match, characters of the match, whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    return F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), part.alias("p")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("len"), (F.length(x["p"]) >= rule.least).alias("counts")),
    )


def _quick(rule: Rule) -> str:
    """Where matches of one repeated class are kept by length, an expression that fails sooner."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("[") else rule.pattern


def _placed(found: DataFrame) -> DataFrame:
    """(doc_id, mark, found array) to one row for each span that counts; running sums give the places."""
    from pyspark.sql import Window

    rows = found.select("doc_id", "mark", F.posexplode("found").alias("at", "x")).select("doc_id", "mark", F.col("x.kind").alias("kind"), "at", F.col("x.gap").alias("gap"), F.col("x.len").alias("len"), F.col("x.counts").alias("counts"))
    rows = rows.distinct()
    upto = Window.partitionBy("doc_id", "mark", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return rows.withColumn("end", end).where("counts").select("doc_id", "mark", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On doc_id, where nulls are equal, and mark."""
    right = right.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how).drop("_id", "_mark")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, n_<kind> for each base rule, base_sha256, spans; one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    asked = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in asked.values() for a in q for t in a})
    low = F.lower("text")
    postings = F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)])))
    index = scratch.save(keyed.select("doc_id", "mark", postings.alias("trigram")))
    wanted = [(trigrams.index(t), k, n, 1 << i, (1 << len(a)) - 1) for k, q in asked.items() for n, a in enumerate(sorted(q, key=sorted)) for i, t in enumerate(sorted(a))]
    wanted = F.broadcast(spark.createDataFrame(wanted, "trigram int, rule int, alternative int, bit long, all long"))
    met = index.join(wanted, "trigram").groupBy("doc_id", "mark", "rule", "alternative", "all").agg(F.bit_or("bit").alias("bits")).where("bits = all")
    candidates = scratch.save(met.groupBy("doc_id", "mark").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules")))
    checked = [F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, _found(F.col("text"), rules[k], k)) for k in asked]
    matched = _joined(keyed, candidates).select("doc_id", "mark", F.explode(F.array(*checked)).alias("found"))
    scanned = [F.when(F.col("text").rlike(_quick(rules[k])), _found(F.col("text"), rules[k]._replace(pattern=_quick(rules[k])), k)) for k in range(len(rules)) if k not in asked]
    if scanned:
        matched = matched.union(keyed.select("doc_id", "mark", F.explode(F.array(*scanned)).alias("found")))
    spans = _placed(matched.where("size(found) > 0"))
    name = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s"))
    lists = spans.groupBy("doc_id", "mark").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:n_base])],
        F.array_sort(F.collect_list(F.when(F.col("kind") < n_base, span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("every"),
    )
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["s"]))
    out = _joined(keyed.select("doc_id", "mark"), lists, "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,s:string>>")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in rules[:n_base]],
        F.sha2(joined(F.coalesce("base", none)), 256).alias("base_sha256"),
        joined(F.coalesce("every", none)).alias("spans"),
    )


def secrets_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE_RULES)) -> str:
    """The same result as SQL for DuckDB, by scanning every text with every rule."""
    parts = []
    for k, r in enumerate(rules):
        quoted = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS kind, '{r.kind}' AS name, unnest(range(1, len(w) + 1)) AS i, w, b, g FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS w, "
            f"string_split_regex(text, '{quoted}') AS b, regexp_extract_all(text, '{quoted}', {r.group}) AS g FROM d)"
        )
    sized = "list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0)"
    kept = " OR ".join(f"(kind = {k} AND length(g[i]) >= {r.least})" for k, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(rules[:n_base]))
    outer = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:n_base])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT doc_id, kind, name, CAST({sized} AS BIGINT) AS s, length(w[i]) AS n FROM m WHERE {kept}),
l AS (SELECT doc_id, {counts}, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (kind < {n_base}) AS base,
      string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, {outer}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (doc_id)"""
