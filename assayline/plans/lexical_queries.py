"""Lexical and identifier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, lexical, numeric
from ..sources.labview import table
from .registry import query


@query("""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS label_md5 FROM documents""")
def normalise_label_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(lexical.normalise_text(F.col("text")).cast("binary")).alias("label_md5"))


@query("""
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS token_chars,
        coalesce(t[len(t)], '') AS last_token FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t FROM documents)""")
def tokenise_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", lexical.tokens(F.col("text")).alias("t"))
    chars = F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), chars.alias("token_chars"), F.coalesce(F.get("t", F.size("t") - 1), F.lit("")).alias("last_token"))


@query("""SELECT p_partkey, 'x:' || regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS marker_key FROM part""")
def slug_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", lexical.derived_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("marker_key"))


@query("""
    WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS t FROM documents),
    y AS (SELECT doc_id, regexp_extract(t, '^[<>≤≥]?\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 1) AS s FROM x)
    SELECT doc_id, count(*) AS n_numbers, min(CAST(replace(s, ',', '.') AS DOUBLE)) AS least, max(CAST(replace(s, ',', '.') AS DOUBLE)) AS most,
        count(*) FILTER (WHERE regexp_matches(s, '^[+-]?[1-9]\\d{0,2}[.,]\\d{3}$')) AS n_ambiguous
    FROM y WHERE s <> '' GROUP BY doc_id""")
def parse_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d")).select("doc_id", F.explode(lexical.tokens(F.col("text"))).alias("t"))
    p = t.where(F.col("t").rlike(r"\d$")).select("doc_id", numeric.parse_number(F.col("t")).alias("p")).where(F.col("p").isNotNull())
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.min("p.value").alias("least"), F.max("p.value").alias("most"), F.count_if("p.ambiguous").alias("n_ambiguous"))


@query("""
    WITH d AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN o_orderkey % 4 = 1 THEN ' ' || strftime(o_orderdate, '%d-%m-%Y') || ' '
            WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '31-%m-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS printed FROM orders)
    SELECT o_orderkey, printed, CASE WHEN regexp_matches(trim(printed), '^\\d{2}-\\d{2}-\\d{4}$') THEN CAST(try_strptime(trim(printed), '%d-%m-%Y') AS DATE) END AS parsed FROM d""")
def document_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, day, k = table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.col("o_orderkey") % 4
    printed = F.when(k == 0, day).when(k == 1, F.concat(F.lit(" "), day, F.lit(" "))).when(k == 2, F.concat(F.lit("31"), F.substring(day, 3, 8))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", printed.alias("printed")).withColumn("parsed", dates.parse_document_date(F.col("printed")))


_FOUND = r"""
    found AS (
        SELECT doc_id, 'national-id' AS kind, unnest(list_distinct(regexp_extract_all(text, '\b\d{11}\b'))) AS found FROM documents UNION ALL
        SELECT doc_id, 'email', unnest(list_distinct(regexp_extract_all(text, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}'))) FROM documents UNION ALL
        SELECT doc_id, 'phone', unnest(list_distinct(regexp_extract_all(text, '(?:\+30[\s-]?)?\b(?:2\d|69)\d(?:[\s-]?\d){7}\b'))) FROM documents)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, kind, found): each identifier once, at its first place in scan order."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d{11}|@|\d(?:[\s-]?\d){7}"))
    return docs.select("doc_id", F.posexplode(F.array_distinct(lexical.identifiers(F.col("text")))).alias("ord", "f")).select("doc_id", "ord", "f.kind", "f.found")


@query(f"WITH {_FOUND} SELECT doc_id, kind, found FROM found")
def identifier_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "kind", "found")


@query(r"""
    SELECT doc_id, md5(CASE WHEN len(regexp_extract_all(text, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}')) = 0 THEN text ELSE trim(regexp_replace(
        list_reduce(list_prepend(text, regexp_extract_all(text, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}')), lambda a, b: replace(a, b, '')), '\s+', ' ', 'g')) END) AS scrubbed_md5 FROM documents""")
def identifier_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    emails = F.regexp_extract_all(F.col("text"), F.lit(dict(lexical.IDENTIFIERS)["email"]), F.lit(0))
    return docs.select("doc_id", F.md5(lexical.scrub(F.col("text"), emails).cast("binary")).alias("scrubbed_md5"))


@query(f"""
    WITH {_FOUND}, n AS (SELECT doc_id, count(*) AS n_found FROM found GROUP BY doc_id)
    SELECT l.doc_id, coalesce(n_found, 0) AS n_found, coalesce(n_found, 0) = 0 OR l.quality = 1 AS may_pass FROM labels l LEFT JOIN n ON l.doc_id = n.doc_id""")
def identifier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _found(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_found"))
    gate = table(spark, sf_dir, "labels").join(n, "doc_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0).cast("long")))
    return gate.select("doc_id", "n_found", ((F.col("n_found") == 0) | (F.col("quality") == 1)).alias("may_pass"))


@query("""
    WITH t AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS label FROM documents)
    SELECT lang, label, count(*) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, label) AS BIGINT) AS place FROM t GROUP BY lang, label""")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by language, most frequent first, with their place.

    No task sorts a whole vocabulary: places are counted within (language, frequency, first letters), and each such
    group starts after the groups before it, of which there are few.
    """
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("lang", F.lower("w").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("head", F.substring("label", 1, 3))
    group = ["lang", "n", "head"]
    sizes = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy(F.desc("n"), "head").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("size").withColumnRenamed("lang", "l2")
    placed = counts.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("label")))
    joined = placed.join(starts, placed["lang"].eqNullSafe(starts["l2"]) & (placed["n"] == starts["n"]) & (placed["head"] == starts["head"]))
    return joined.select(placed["lang"], "label", placed["n"], (F.col("at") + F.col("before")).cast("long").alias("place"))
