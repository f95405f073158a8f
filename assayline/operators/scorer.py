"""Scoring emitted rows against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import close_to


def paired(expected: DataFrame, actual: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One-to-one pairs: the k-th emitted row of a key answers the k-th expected one; leftovers stay alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    number = lambda df, name: df.withColumn("_rn", F.row_number().over(w)).select(*keys, "_rn", F.col("v").alias(name), F.lit(True).alias(f"has_{name}"))
    both = number(expected, "expected").join(number(actual, "actual"), [*keys, "_rn"], "full")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_expected", "has_actual")})


def counts(pairs: DataFrame, by: str) -> DataFrame:
    """Matched, expected, spurious and correct rows."""
    e, a = F.col("has_expected"), F.col("has_actual")
    return pairs.groupBy(by).agg(F.count_if(e & a).alias("matched"), F.count_if(e).alias("expected"), F.count_if(~e).alias("spurious"),
                                 F.count_if(e & a & close_to(F.col("expected"), F.col("actual"))).alias("correct"))


def breaches(totals: DataFrame, floors: DataFrame) -> DataFrame:
    """Scopes below their floor; nothing judged passes every floor."""
    j = totals.join(F.broadcast(floors), "scope")
    return j.where((F.col("total") > 0) & (F.col("correct") * 100 < F.col("floor_pct") * F.col("total"))).select("scope", "floor_pct", "correct", "total")


def score(expected: DataFrame, emitted: DataFrame, not_scored: DataFrame, by: str) -> DataFrame:
    """Counts for each ``by``: recall, values, and units and ranges by opportunity; markers in ``not_scored`` are left out and counted.

    Rows are (report_id, row_no, marker_key, value, unit, range_min, <by>). A field counts where either side of a pair, or a
    spurious row, prints it; it is right where both print the same.
    """
    skipped = F.broadcast(not_scored.select("marker_key"))
    w = Window.partitionBy("report_id", "marker_key").orderBy("row_no")
    side = lambda df, s: df.join(skipped, "marker_key", "left_anti").withColumn("_k", F.row_number().over(w)).select("report_id", "marker_key", "_k", F.lit(True).alias(f"_{s}"), F.col(by).alias(f"{s}_by"), *[F.col(c).alias(f"{s}_{c}") for c in ("value", "unit", "range_min")])
    j = side(expected, "e").join(side(emitted, "a"), ["report_id", "marker_key", "_k"], "full").withColumn(by, F.coalesce("e_by", "a_by"))
    he, ha = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    chance = lambda c: ha & (F.col(f"a_{c}").isNotNull() | (he & F.col(f"e_{c}").isNotNull()))
    right = lambda c: F.coalesce(he & ha & (F.col(f"e_{c}") == F.col(f"a_{c}")), F.lit(False))
    counts_ = j.groupBy(by).agg(
        F.count_if(he & ha).alias("matched"), F.count_if(he).alias("expected"), F.count_if(ha).alias("judged"), F.count_if(he & ha & F.col("e_value").eqNullSafe(F.col("a_value"))).alias("values_correct"),
        F.count_if(chance("unit")).alias("unit_total"), F.count_if(right("unit")).alias("unit_correct"), F.count_if(chance("range_min")).alias("range_total"), F.count_if(right("range_min")).alias("range_correct"))
    unjudged = emitted.join(skipped, "marker_key", "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("unjudged"))
    return counts_.join(unjudged, by, "left").withColumn("unjudged", F.coalesce("unjudged", F.lit(0).cast("long")))


def unscorable(rows: DataFrame, table: str, order: str) -> DataFrame:
    """(table, fault, first_row, n_faults): tables with a row that scoring cannot compare, and the first fault."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    s, v = F.col("status"), F.col("value")
    fault = (F.when(F.coalesce("marker_key", F.lit("")) == "", "no-marker-key").when(~s.isin("value", "categorical", "missing"), "unknown-status").when(bad(v), "not-finite").when((s == "value") & v.isNull(), "value-missing")
             .when((s == "missing") & (v.isNotNull() | F.col("comparator").isNotNull()), "missing-with-value").when((F.col("range_kind") == "closed") & (F.col("range_min") > F.col("range_max")), "range-order"))
    found = rows.withColumn("fault", fault).where(F.col("fault").isNotNull())
    return found.groupBy(table).agg(F.min_by("fault", order).alias("fault"), F.min(order).alias("first_row"), F.count(F.lit(1)).alias("n_faults"))


#: For each metric what was right and what was asked.
METRICS = {"recall": ("matched", "expected"), "value": ("values_correct", "judged"), "unit": ("unit_correct", "unit_total"), "range": ("range_correct", "range_total")}


def release_breaches(scores: DataFrame, by: str, floors: DataFrame) -> DataFrame:
    """(scope, metric, floor_pct, correct, total) of the metrics below their floor: scores of each ``by`` (one = 1) and of all together (one = 0)."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("correct"), F.col(t).alias("total")) for m, (c, t) in METRICS.items()])
    single = scores.select(F.col(by).cast("string").alias("scope"), F.lit(1).alias("one"), F.inline(parts))
    whole = single.groupBy("metric").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).select(F.lit("all").alias("scope"), F.lit(0).alias("one"), "metric", "correct", "total")
    j = single.unionByName(whole).join(F.broadcast(floors), ["one", "metric"])
    return j.where((F.col("total") > 0) & (F.col("correct") * 100 < F.col("floor_pct") * F.col("total"))).select("scope", "metric", "floor_pct", "correct", "total")
