"""A deterministic entity-resolution corpus derived from the part table, as SQL for two engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HELD_OUT = "PROMO"


def hashed(text: str, modulus: int, duck: bool) -> str:
    """The first 32 bits of the md5 of text, modulo."""
    if duck:
        return f"(('0x' || substr(md5({text}), 1, 8))::bigint % {modulus})"
    return f"(cast(conv(substr(md5({text}), 1, 8), 16, 10) as bigint) % {modulus})"


def records_sql(duck: bool, part: str = "part") -> str:
    """entity_id, src, name, addr, country, true_s1 and the part key ks."""
    h = lambda text, m: hashed(text, m, duck)
    pad = "lpad(cast(no as varchar), 4, '0')" if duck else "lpad(cast(no as string), 4, '0')"
    text = "varchar" if duck else "string"
    base = f"SELECT cast(p_partkey as {text}) AS ks, p_type AS country, p_name || ' ' || substr(p_brand, 7) AS nm, cast((p_partkey * 37) % 1999 + 1 as int) AS no, p_size AS size FROM {part}"
    parts = [f"SELECT 'S1-' || ks AS entity_id, 1 AS src, nm AS name, no || ' zone ' || size || ' street, ' || country AS addr, country, '' AS true_s1, ks FROM base"]
    for s in (2, 3):
        noisy = f"SELECT *, {h(f'''concat('d{s}', ks)''', 4)} = 0 AS d, {h(f'''concat('n{s}', ks)''', 8)} AS nn, {h(f'''concat('a{s}', ks)''', 8)} AS an FROM base WHERE {h(f'''concat('p{s}', ks)''', 10)} < 8"
        moved = f"SELECT ks, country, size, nn, an, d, CASE WHEN d THEN no + 3 ELSE no END AS no, CASE WHEN d THEN nm || ' & Sons' ELSE nm END AS nm FROM ({noisy}) q"
        # source 3 has names in another script, letter for letter
        native = "nm" if s == 2 else "translate(lower(nm), 'abcdefghijklmnoprstuvxyz', 'абцдефгхижклмнопрстувхыз')"
        name = f"CASE nn WHEN 0 THEN '-- ' || nm WHEN 1 THEN nm || ' Pvt Ltd' WHEN 2 THEN upper(nm) WHEN 3 THEN nm || ' | www.' || replace(nm, ' ', '') || '.com' WHEN 4 THEN 'Old ' || nm || ' dba ' || nm WHEN 5 THEN replace(nm, 'e', 'é') WHEN 6 THEN 'Sri ' || nm ELSE {native} END"
        addr = f"CASE an WHEN 0 THEN '' WHEN 1 THEN country || ', 0' || no || ' zone ' || size || ' st' WHEN 2 THEN 'null, ' || no || ' zone ' || size || ' street' WHEN 3 THEN no || ' zone ' || size || ' street, ' || country || ', 9876543' || {pad} ELSE no || ' zone ' || size || ' street, ' || country END"
        parts.append(f"SELECT 'S{s}-' || ks AS entity_id, {s} AS src, {name} AS name, {addr} AS addr, country, CASE WHEN d THEN '' ELSE 'S1-' || ks END AS true_s1, ks FROM ({moved}) m")
    return f"WITH base AS ({base}) " + " UNION ALL ".join(parts)


def pairs_sql(duck: bool, records: str) -> str:
    """s1, rec, country, p, y: each record against three S1 entities of its country, with a score of controlled ties."""
    h = hashed("concat(s.entity_id, r.entity_id)", 100, duck)
    near = "cast(r.ks as bigint) - cast(s.ks as bigint)"
    p = f"cast(CASE WHEN r.true_s1 = s.entity_id THEN 50 + {h} / 2 ELSE {h} END as double) / 100"
    if not duck:
        p = p.replace(f"{h} / 2", f"{h} div 2")
    else:
        p = p.replace(f"{h} / 2", f"{h} // 2")
    # neighbours by key, dealt by equality so that either engine hashes the join
    off = "unnest([0, 1, 2, 3, 4, 5])" if duck else "explode(array(0, 1, 2, 3, 4, 5))"
    return f"SELECT s.entity_id AS s1, r.entity_id AS rec, r.country, {p} AS p, cast(r.true_s1 = s.entity_id as int) AS y FROM (SELECT *, {off} AS off FROM {records} WHERE src > 1) r JOIN {records} s ON s.src = 1 AND cast(s.ks as bigint) = cast(r.ks as bigint) - r.off AND s.country = r.country WHERE {near} >= 0"


class Fixture:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        self.records = spark.sql(records_sql(False, "{part}"), part=part)

    @property
    def s1(self) -> DataFrame:
        return self.records.where("src = 1").selectExpr("entity_id AS s1", "country")

    @property
    def truth(self) -> DataFrame:
        return self.records.where("true_s1 <> ''").selectExpr("true_s1 AS s1", "entity_id AS rec")

    @property
    def pairs(self) -> DataFrame:
        return self.spark.sql(pairs_sql(False, "{records}"), records=self.records)


DUCK_CTES = f"records AS ({records_sql(True)}), s1s AS (SELECT entity_id AS s1, country FROM records WHERE src = 1), truth AS (SELECT true_s1 AS s1, entity_id AS rec FROM records WHERE true_s1 <> ''), pairs AS ({pairs_sql(True, 'records')})"
