"""Searches over classes of equal vectors: copies are searched once, and every query is answered with its own rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread_join


def best_classes(scores: np.ndarray, smallest: np.ndarray, want: int) -> np.ndarray:
    """The ``want`` best rows by score, ties to the smaller id."""
    kept = np.flatnonzero(scores >= np.partition(scores, -want)[-want]) if len(scores) > want else np.arange(len(scores))
    return kept[np.lexsort((smallest[kept], -scores[kept]))[:want]]


def listed(found: DataFrame, want: int) -> DataFrame:
    """(qno, near): the ``want`` best (vec_id, score) of each query, from (qno, vec_id, score)."""
    place = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id"))
    kept = found.withColumn("place", place).where(F.col("place") <= want)
    return kept.groupBy("qno").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))), lambda s: F.struct(s["vec_id"].alias("vec_id"), s["score"].alias("score"))).alias("near"))


def answers(rows: DataFrame, is_query: Column, k: int, search: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best rows of another id, ties to the smaller id.

    ``rows``: (vec_id, v), each pair once, written down. ``search`` takes classes (v, ids, salt), the distinct vectors asked with (v, times, qno)
    and how many rows to list, and returns (qno, near). A class keeps only its smallest ids, as many as any answer can need: an answer
    leaves out the query's own id, so as many more rows are kept as one id has vectors.
    """
    queries = rows.where(is_query)
    want = k + (queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= want)
    classes = materialise(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("salt", F.xxhash64("v")), "classes")
    asked = materialise(queries.groupBy("v").agg(F.count(F.lit(1)).alias("times")).withColumn("qno", F.monotonically_increasing_id()), "asked")
    found = materialise(asked.join(search(classes, asked, want), "qno").select("v", "times", "near"), "listed")
    own = spread_join(queries, found, "v").withColumn("near", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("vec_id")), 1, k))
    out = own.select(F.col("vec_id").alias("query_id"), F.posexplode("near").alias("place", "s"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "s.vec_id", "s.score")
