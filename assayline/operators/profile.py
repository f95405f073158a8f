"""Profiles: merge plans, overlays, same-day precision and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import CONTROL, IDENTIFIERS

LONGEST_LABEL = 120


def _content(df: DataFrame, key: str) -> Column:
    return F.struct(*[c for c in df.columns if c != key])


def merge_plan(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Arriving reports with what becomes of each: addition, duplicate or report-id conflict."""
    old = stored.select(key, _content(stored, key).alias("_old"))
    joined = arriving.join(old, key, "left")
    same = F.col("_old").eqNullSafe(_content(arriving, key))
    return joined.withColumn("outcome", F.when(F.col("_old").isNull(), "addition").when(same, "duplicate").otherwise("report-id")).drop("_old")


def same_day_conflicts(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs on one day of which either has no time; reports (profile_id, report_id, collected_date, time)."""
    a = added.select("profile_id", F.col("collected_date").alias("day"), F.col("report_id").alias("added_id"), F.col("time").alias("_ta"))
    s = stored.select("profile_id", F.col("collected_date").alias("day"), F.col("report_id").alias("stored_id"), F.col("time").alias("_ts"))
    return a.join(s, ["profile_id", "day"]).where(F.col("_ta").isNull() | F.col("_ts").isNull()).select("added_id", "stored_id", "day")


def overlay(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Stored rows, replaced where changed, and the rest of the changed ones appended.

    One full outer join on the key instead of a join and an anti-join; ``outcome`` says which.
    """
    fields = [c for c in stored.columns if c != key]
    old, new = stored.select(key, F.struct(*fields).alias("_old")), changed.select(key, F.struct(*fields).alias("_new"))
    both = old.join(new, key, "full")
    outcome = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return both.select(key, *[F.coalesce(F.col("_new")[c], F.col("_old")[c]).alias(c) for c in fields], outcome.alias("outcome"))


def same_day_precision(reports: DataFrame) -> DataFrame:
    """Per profile and day: several reports are allowed only with as many distinct times."""
    per_time = reports.groupBy("profile_id", "collected_date", "time").agg(F.count(F.lit(1)).alias("n"))
    g = per_time.groupBy("profile_id", "collected_date").agg(F.sum("n").alias("n_reports"), F.bool_and(F.col("time").isNotNull() & (F.col("n") == 1)).alias("ok"))
    return g.select("profile_id", "collected_date", "n_reports", ((F.col("n_reports") < 2) | F.col("ok")).alias("allowed"))


def resolve_same_day(reports: DataFrame) -> DataFrame:
    """Stamp distinct times on reports that share a day; others keep day precision."""
    day = Window.partitionBy("profile_id", "collected_date")
    hour = F.row_number().over(day.orderBy("report_id")) - 1
    return reports.withColumn("time", F.when(F.count(F.lit(1)).over(day) > 1, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))))


def uniqueness_violations(reports: DataFrame, measurements: DataFrame) -> DataFrame:
    """Report ids and (report, marker) keys that occur more than once."""
    many = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    m = many(measurements, ["report_id", "marker_key"]).select(F.lit("measurement").alias("subject"), "report_id", "marker_key", "n")
    r = many(reports, ["report_id"]).select(F.lit("report").alias("subject"), "report_id", F.lit(None).cast("string").alias("marker_key"), "n")
    return m.unionByName(r)


def _infinite(name: str) -> Column:
    return F.isnan(name) | (F.abs(name) == float("inf"))


#: Rules every measurement must keep: the columns a rule looks at and when it is broken, in the order that names the first fault.
RULES = {
    "status": (("status",), lambda: ~F.coalesce(F.col("status").isin("value", "categorical", "missing"), F.lit(False))),
    "value-missing": (("status", "value"), lambda: (F.col("status") == "value") & F.col("value").isNull()),
    "missing-with-value": (("status", "value"), lambda: (F.col("status") == "missing") & F.col("value").isNotNull()),
    "categorical-with-value": (("status", "value"), lambda: (F.col("status") == "categorical") & F.col("value").isNotNull()),
    "categorical-without-text": (("status", "text_value"), lambda: (F.col("status") == "categorical") & (F.trim(F.coalesce("text_value", F.lit(""))) == "")),
    "comparator": (("comparator", "status"), lambda: F.col("comparator").isNotNull() & (~F.col("comparator").isin("<", "<=", ">", ">=") | (F.col("status") != "value"))),
    "range-order": (("range_kind", "range_min", "range_max"), lambda: (F.col("range_kind") == "closed") & (F.col("range_min") > F.col("range_max"))),
    "range-direction": (("range_kind", "range_comparator"), lambda: ((F.col("range_kind") == "minOnly") & ~F.col("range_comparator").isin(">", ">=")) | ((F.col("range_kind") == "maxOnly") & ~F.col("range_comparator").isin("<", "<="))),
    "range-bound": (("range_kind", "range_min", "range_max"), lambda: (F.col("range_kind").isin("closed", "minOnly") & (F.col("range_min").isNull() | _infinite("range_min"))) | (F.col("range_kind").isin("closed", "maxOnly") & (F.col("range_max").isNull() | _infinite("range_max")))),
    "not-finite": (("value",), lambda: _infinite("value")),
    "marker-key": (("marker_key",), lambda: ~F.col("marker_key").rlike(r"^(x:)?[\p{L}\p{N}-]+$")),
    "empty-key": (("marker_key",), lambda: F.coalesce(F.col("marker_key"), F.lit("")) == ""),
}


def measurement_violations(measurements: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each measurement once for every rule it breaks, in one pass; rules over columns that are not there do not apply."""
    rules = {name: rule() for name, (needed, rule) in RULES.items() if set(needed) <= set(measurements.columns)} | (extra or {})
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return measurements.withColumn("rule", F.explode(broken))


def apply_merge(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(profile_id, error, n_reports) of every profile after a merge.

    Reports are (profile_id, report_id, collected_date, time, ...). A report id held with other content refuses
    the whole profile, then a day shared without times; a refused profile keeps what it had.
    """
    plan = merge_plan(stored, arriving, "report_id")
    added = plan.where(F.col("outcome") == "addition").drop("outcome")
    days = same_day_conflicts(stored, added).join(added.select(F.col("report_id").alias("added_id"), "profile_id"), "added_id").select("profile_id", F.lit(True).alias("_day"))
    per = plan.groupBy("profile_id").agg(F.count_if(F.col("outcome") == "addition").alias("_added"), F.bool_or(F.col("outcome") == "report-id").alias("_id"))
    held = stored.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_held"))
    j = held.join(per, "profile_id", "full").join(days.distinct(), "profile_id", "left")
    error = F.when(F.col("_id"), "report-id-conflict").when(F.col("_day"), "same-day-precision-conflict")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return j.withColumn("error", error).select("profile_id", "error", (zero("_held") + F.when(F.col("error").isNull(), zero("_added")).otherwise(0)).alias("n_reports"))


def unsafe_labels(measurements: DataFrame) -> DataFrame:
    """Each labelled measurement once for every reason that its label may not be stored."""
    label = F.col("label")
    identifier = {f"label-{kind}": label.rlike(pattern) for kind, pattern in IDENTIFIERS}
    rules = {"label-on-known-key": ~F.startswith(F.col("marker_key"), F.lit("x:")), "label-too-long": F.length(label) > LONGEST_LABEL, "label-control-characters": label.rlike(CONTROL)} | identifier
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return measurements.where(label.isNotNull()).withColumn("rule", F.explode(broken))


def validated(measurements: DataFrame, broken: Column, field: str) -> DataFrame:
    """(report_id, written, path): a report is written whole or not at all; ``path`` names the first field that breaks a rule."""
    bad = F.coalesce(broken, F.lit(False))
    g = measurements.groupBy("report_id").agg(F.min(F.when(bad, F.col("row_no"))).alias("_first"))
    path = F.concat(F.lit("reports["), F.col("report_id").cast("string"), F.lit("].measurements["), F.col("_first").cast("string"), F.lit(f"].{field}"))
    return g.select("report_id", F.col("_first").isNull().alias("written"), path.alias("path"))


def evidence(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """References (source_id, page) with what can be shown: evidence, unavailable, unknown-source or unknown-page."""
    j = refs.join(sources.withColumn("_s", F.lit(True)), "source_id", "left")
    outcome = (F.when(F.col("_s").isNull(), "unknown-source").when(~F.col("evidence_available"), "unavailable").when(~F.col("held"), "unknown-source")
               .when(~F.col("page").between(1, F.col("pages")), "unknown-page").otherwise("evidence"))
    return j.withColumn("outcome", outcome).drop("_s")
