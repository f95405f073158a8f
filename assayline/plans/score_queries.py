"""Scoring: pairing, counts, totals and release floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scorer
from ..sources.labview import LINE_ORDER, table
from .registry import query, values

_PAIR_SQL = """
    e AS (SELECT l_orderkey AS doc, l_partkey % 50 AS key, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rn
        FROM lineitem WHERE l_linestatus = 'O'),
    a AS (SELECT l_orderkey AS doc, l_partkey % 50 AS key, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rn
        FROM lineitem WHERE l_linestatus = 'F'),
    p AS (SELECT coalesce(e.doc, a.doc) AS doc, e.v AS expected, a.v AS actual, e.doc IS NOT NULL AS wanted, a.doc IS NOT NULL AS emitted FROM e FULL JOIN a ON e.doc = a.doc AND e.key = a.key AND e.rn = a.rn)"""


@query(f"""WITH {_PAIR_SQL} SELECT doc, count(*) FILTER (WHERE wanted AND emitted) AS matched, count(*) FILTER (WHERE wanted) AS expected, count(*) FILTER (WHERE NOT wanted) AS spurious,
    count(*) FILTER (WHERE wanted AND emitted AND abs(expected - actual) <= greatest(1e-9, abs(expected) * 1e-6)) AS correct FROM p GROUP BY doc""")
def scorer_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50).alias("key"), F.col("l_quantity").alias("v"), "l_linestatus", *LINE_ORDER)
    return scorer.counts(scorer.paired(li.where(F.col("l_linestatus") == "O"), li.where(F.col("l_linestatus") == "F"), ["doc", "key"], LINE_ORDER), "doc")


_SCORE_SQL = """s AS (SELECT d.lang, d.source, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END = l.quality AS "right" FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"""WITH {_SCORE_SQL} SELECT lang, source, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level, count(*) AS total, count(*) FILTER (WHERE "right") AS correct
    FROM s GROUP BY ROLLUP (lang, source)""")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _scored(spark, sf_dir).rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct"))
    return r.select("lang", "source", "level", "total", "correct")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("lang", "source", (F.when(F.col("n_chars") > 2000, 1).otherwise(0) == F.col("quality")).alias("right"))


_FLOORS = "('aggregate', 95), ('en', 30), ('de', 90), ('fr', 30), ('es', 10)"


@query(f"""WITH {_SCORE_SQL}, t AS (SELECT coalesce(lang, 'aggregate') AS scope, count(*) AS total, count(*) FILTER (WHERE "right") AS correct FROM s GROUP BY ROLLUP (lang))
    SELECT t.scope, floor_pct, correct, total FROM t JOIN (VALUES {_FLOORS}) f(scope, floor_pct) ON t.scope = f.scope WHERE total > 0 AND correct * 100 < floor_pct * total""")
def release_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scored(spark, sf_dir).rollup("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct")).withColumn("scope", F.coalesce("lang", F.lit("aggregate")))
    return scorer.breaches(t, values(spark, _FLOORS, "scope, floor_pct"))
