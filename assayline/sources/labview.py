"""The lab view: reports and measurements over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Conversion factors by remainder of the part key modulo 3; the third kind has none.
FACTORS = {0: 0.05551, 1: 0.02586}
CANONICAL = "mg/dL"
#: What orders the lines of a report: (orderkey, linenumber) alone is not unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("profile_id"), F.to_date("o_orderdate").alias("collected_date"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item with its part's range; value and comparator are null if missing."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("size"))
    missing = F.col("l_returnflag") == "R"
    kind = F.when(F.col("p_type") == "PROMO", "minOnly").when(F.col("p_type") == "SMALL", "maxOnly").when(F.col("p_type") != "ECONOMY", "closed")
    m = li.join(part, li["l_partkey"] == part["p_partkey"])
    return m.select(
        F.col("l_orderkey").alias("report_id"), *LINE_ORDER, F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("marker_key"),
        F.when(~missing, F.col("l_quantity")).alias("value"), F.when(missing, "missing").otherwise("value").alias("status"),
        F.when(~missing & (F.col("l_tax") >= 0.07), "<").alias("comparator"), F.when(F.col("l_linestatus") == "O", "mg/dL").otherwise("mmol/L").alias("unit"),
        kind.alias("range_kind"), F.when(kind.isin("closed", "minOnly"), F.col("size")).alias("range_min"),
        F.when(kind == "closed", F.col("size") + 20).when(kind == "maxOnly", F.col("size")).alias("range_max"),
        F.when(kind == "minOnly", ">=").when(kind == "maxOnly", "<").alias("range_comparator"))


MEASUREMENTS_SQL = """
    reports AS (
        SELECT o_orderkey AS report_id, o_custkey AS profile_id, CAST(o_orderdate AS DATE) AS collected_date FROM orders
    ), kinds AS (
        SELECT p_partkey, CAST(p_size AS DOUBLE) AS size,
            CASE p_type WHEN 'PROMO' THEN 'minOnly' WHEN 'SMALL' THEN 'maxOnly' WHEN 'ECONOMY' THEN NULL ELSE 'closed' END AS kind FROM part
    ), measurements AS (
        SELECT l_orderkey AS report_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, 'm' || l_partkey AS marker_key,
            CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS value, CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE 'value' END AS status,
            CASE WHEN l_returnflag <> 'R' AND l_tax >= 0.07 THEN '<' END AS comparator, CASE l_linestatus WHEN 'O' THEN 'mg/dL' ELSE 'mmol/L' END AS unit,
            kind AS range_kind, CASE WHEN kind IN ('closed', 'minOnly') THEN size END AS range_min,
            CASE kind WHEN 'closed' THEN size + 20 WHEN 'maxOnly' THEN size END AS range_max,
            CASE kind WHEN 'minOnly' THEN '>=' WHEN 'maxOnly' THEN '<' END AS range_comparator
        FROM lineitem JOIN kinds ON l_partkey = p_partkey
    )"""


def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as the rows of review drafts, numbered in printed order; a tenth of the markers is unknown."""
    m, key = measurements(spark, sf_dir), F.col("l_partkey")
    key = F.when(key % 10 == 7, F.concat(F.lit("x:m"), key.cast("string"))).otherwise(F.concat(F.lit("m"), (key % 25).cast("string")))
    row_no = F.row_number().over(Window.partitionBy("report_id").orderBy(*LINE_ORDER)).cast("long")
    return m.withColumn("marker_key", key).withColumn("row_no", row_no)


DRAFTS_SQL = MEASUREMENTS_SQL + f""", draft_rows AS (
        SELECT * REPLACE (CASE WHEN l_partkey % 10 = 7 THEN 'x:m' || l_partkey ELSE 'm' || (l_partkey % 25) END AS marker_key),
            row_number() OVER (PARTITION BY report_id ORDER BY {', '.join(LINE_ORDER)}) AS row_no FROM measurements
    )"""
