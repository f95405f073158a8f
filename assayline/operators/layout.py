"""Printed rows and lines from positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_SHARE, BELOW_REACH, BELOW_OVERLAP = 0.6, 2.5, 0.5


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def same_row(a: str, b: str) -> Column:
    """Centres closer than 0.6 of the smaller height."""
    centre = lambda s: _c(s, "y") + _c(s, "h") / 2
    return F.abs(centre(a) - centre(b)) < ROW_SHARE * F.least(_c(a, "h"), _c(b, "h"))


def sits_below(a: str, b: str) -> Column:
    """b lies under a: half the smaller width overlaps, and the gap is 2.5 heights at most."""
    overlap = F.least(_c(a, "x") + _c(a, "w"), _c(b, "x") + _c(b, "w")) - F.greatest(_c(a, "x"), _c(b, "x"))
    gap = _c(b, "y") - _c(a, "y") - _c(a, "h")
    return (overlap >= BELOW_OVERLAP * F.least(_c(a, "w"), _c(b, "w"))) & gap.between(0, BELOW_REACH * _c(a, "h"))


def row_numbers(items: Column) -> Column:
    """The row number of each item of a page, from 1; items (structs with y and h) come in (y, x) order.

    One row is open at a time; an item joins it if it is on one row with any of its members, else it opens the next.
    Rows are never reopened, so the fold carries the open row's centres and heights and the numbers so far.
    """
    centre = lambda i: i["y"] + i["h"] / 2
    member = lambda i: F.struct(centre(i).alias("c"), i["h"].alias("h"))
    start = F.struct(F.array().cast("array<struct<c:double,h:double>>").alias("open"), F.array().cast("array<int>").alias("nos"))

    def step(state: Column, i: Column) -> Column:
        joins = F.exists(state["open"], lambda m: F.abs(centre(i) - m["c"]) < ROW_SHARE * F.least(i["h"], m["h"]))
        last = F.coalesce(F.get(state["nos"], F.size(state["nos"]) - 1), F.lit(0))
        return F.when(joins, F.struct(F.concat(state["open"], F.array(member(i))).alias("open"), F.concat(state["nos"], F.array(last)).alias("nos"))).otherwise(
            F.struct(F.array(member(i)).alias("open"), F.concat(state["nos"], F.array(last + 1)).alias("nos")))

    return F.aggregate(items, start, step, lambda state: state["nos"])


def cluster_rows(items: DataFrame) -> DataFrame:
    """Items (source_id, page, item, text, x, y, w, h) with their printed row's number.

    Pages are folded apart; a source's rows are numbered across its pages by a prefix sum over one line a page. All
    of it, and every window by source behind it, reads one exchange by source.
    """
    listed = F.array_sort(F.collect_list(F.struct("y", "x", "item", "text", "w", "h")))
    pages = items.repartition("source_id").groupBy("source_id", "page").agg(listed.alias("_items")).withColumn("_nos", row_numbers(F.col("_items")))
    earlier = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_before", F.coalesce(F.sum(F.array_max("_nos")).over(earlier), F.lit(0)))
    out = pages.select("source_id", "page", "_before", F.inline(F.arrays_zip(F.col("_items").alias("i"), F.col("_nos").alias("n"))))
    return out.select("source_id", F.col("page").cast("int").alias("page"), (F.col("_before") + F.col("n")).cast("int").alias("row_no"), F.col("i.item").cast("int").alias("item"), "i.text", "i.x", "i.y", "i.w", "i.h")


def rows_of(clustered: DataFrame) -> DataFrame:
    """One line per printed row: its items left to right, their joined text and the row's band."""
    items = F.array_sort(F.collect_list(F.struct("x", "y", "item", "text", "w", "h")))
    one = F.count(F.lit(1)) == 1
    g = clustered.groupBy("source_id", "page", "row_no").agg(
        items.alias("items"), F.min("y").alias("y"), F.when(one, F.min("h")).otherwise(F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    return g.withColumn("text", F.array_join(F.transform("items", lambda i: i["text"]), " "))


def _line_numbers(items: Column) -> Column:
    """The line number of each item of a page: an item joins the open line if it overlaps that line's first item in height."""
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("end"), F.array().cast("array<int>").alias("nos"))

    def step(state: Column, i: Column) -> Column:
        joins = F.coalesce((i["y"] < state["end"]) & (state["y"] < i["y"] + i["h"]), F.lit(False))
        last = F.coalesce(F.get(state["nos"], F.size(state["nos"]) - 1), F.lit(0))
        return F.when(joins, F.struct(state["y"].alias("y"), state["end"].alias("end"), F.concat(state["nos"], F.array(last)).alias("nos"))).otherwise(
            F.struct(i["y"].alias("y"), (i["y"] + i["h"]).alias("end"), F.concat(state["nos"], F.array(last + 1)).alias("nos")))

    return F.aggregate(items, start, step, lambda state: state["nos"])


def assemble_lines(items: DataFrame) -> DataFrame:
    """Lines of each page with their items' texts joined by one blank, and where in the line each of them starts (code points)."""
    listed = F.array_sort(F.collect_list(F.struct("y", "x", "item", "text", "h")))
    pages = items.groupBy("source_id", "page").agg(listed.alias("_items"))
    numbered = pages.select("source_id", "page", F.inline(F.arrays_zip(F.col("_items").alias("i"), _line_numbers(F.col("_items")).alias("line_no"))))
    g = numbered.groupBy("source_id", "page", "line_no").agg(F.array_sort(F.collect_list(F.struct("i.x", "i.item", "i.text"))).alias("l"))
    g = g.withColumn("t", F.transform("l", lambda i: i["text"]))
    starts = F.aggregate("t", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, t: F.struct((s["at"] + F.length(t) + 1).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    return g.select("source_id", F.col("page").cast("int").alias("page"), "line_no", F.array_join("t", " ").alias("text"), F.size("l").alias("n_items"), starts.alias("starts"))


def out_of_bounds(items: DataFrame) -> DataFrame:
    """Items with the first reason that they cannot stand on a page; those that can are left out."""
    fault = (F.when(F.coalesce("text", F.lit("")) == "", "empty-text").when((F.col("x") < 0) | (F.col("y") < 0), "off-page")
             .when(F.col("x") + F.col("w") > 1, "too-wide").when(F.col("y") + F.col("h") > 1, "too-high"))
    return items.withColumn("fault", fault).where(F.col("fault").isNotNull())
