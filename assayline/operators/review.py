"""Review sessions: conflicts, edits and gates over draft rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_conflicts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keys held by two or more rows, with those rows' line numbers in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order)))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), listed.alias("_l")).where(F.col("n") >= 2)
    return g.select(*keys, "n", F.array_join(F.transform("_l", lambda s: s[order[0]].cast("string")), ",").alias("lines"))


def reassign(rows: DataFrame, which: Column, key: Column) -> DataFrame:
    """Give the chosen rows another marker key; all others stay as they are."""
    return rows.withColumn("marker_key", F.when(which, key).otherwise(F.col("marker_key")))


def delete(rows: DataFrame, which: Column) -> DataFrame:
    """Drop the chosen rows; a row for which the condition is unknown stays."""
    return rows.where(~F.coalesce(which, F.lit(False)))
