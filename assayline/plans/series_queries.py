"""Series building, trend geometry, panels and meters over the lab view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.numeric import range_status as status_of
from ..sources.labview import CANONICAL, FACTORS, LINE_ORDER, MEASUREMENTS_SQL, measurements, reports, table
from .registry import query


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measurement placed in its series, in the series' unit.

    A native unit equal or convertible to the canonical one joins the canonical series; any other
    forms a series of its own. Native fields stay beside the converted ones.
    """
    m = measurements(spark, sf_dir).join(reports(spark, sf_dir), "report_id")
    key = F.substring("marker_key", 2, 20).cast("long") % 3
    factor = F.when(key == 0, FACTORS[0]).when(key == 1, FACTORS[1])
    native = F.col("unit") == CANONICAL
    target = F.when(native | factor.isNotNull(), CANONICAL).otherwise(F.col("unit"))
    forward = F.when(~native & factor.isNotNull(), False)
    to = lambda c: units.convert(F.col(c), factor, forward)
    return m.select("profile_id", "report_id", *LINE_ORDER, "collected_date", "marker_key", F.concat_ws("@", "marker_key", target).alias("series_id"), "status", "comparator", "unit",
                    F.col("value").alias("native_value"), to("value").alias("value"), "range_kind", to("range_min").alias("range_min"), to("range_max").alias("range_max"), "range_comparator")


_ORDER = ["collected_date", "report_id", *LINE_ORDER]
_POINTS_SQL = MEASUREMENTS_SQL + f""", placed AS (
        SELECT *, CASE l_partkey % 3 WHEN 0 THEN {FACTORS[0]} WHEN 1 THEN {FACTORS[1]} END AS factor FROM measurements JOIN reports USING (report_id)
    ), points AS (
        SELECT profile_id, report_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, collected_date, marker_key,
            marker_key || '@' || CASE WHEN unit = 'mg/dL' OR factor IS NOT NULL THEN 'mg/dL' ELSE unit END AS series_id, status, comparator, unit, value AS native_value,
            CASE WHEN unit <> 'mg/dL' AND factor IS NOT NULL THEN value / factor ELSE value END AS value, range_kind,
            CASE WHEN unit <> 'mg/dL' AND factor IS NOT NULL THEN range_min / factor ELSE range_min END AS range_min,
            CASE WHEN unit <> 'mg/dL' AND factor IS NOT NULL THEN range_max / factor ELSE range_max END AS range_max, range_comparator
        FROM placed)"""
_ORD_SQL = "ORDER BY collected_date, report_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"
_WITH = f"WITH {_POINTS_SQL} "


def _series() -> Window:
    return Window.partitionBy("profile_id", "series_id").orderBy(*_ORDER)


@query(_WITH + f"""SELECT profile_id, series_id, CAST(row_number() OVER (PARTITION BY profile_id, series_id {_ORD_SQL}) AS BIGINT) AS pt_ord, collected_date, status, comparator, unit,
    native_value, round(value, 9) AS value, range_kind, round(range_min, 9) AS range_min, round(range_max, 9) AS range_max FROM points""")
def series_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series_points(spark, sf_dir).withColumn("pt_ord", F.row_number().over(_series()).cast("long"))
    return p.select("profile_id", "series_id", "pt_ord", "collected_date", "status", "comparator", "unit", "native_value", F.round("value", 9).alias("value"), "range_kind",
                    F.round("range_min", 9).alias("range_min"), F.round("range_max", 9).alias("range_max"))


@query(_WITH + """SELECT marker_key, series_id, count(*) AS n_points, count(value) AS n_values, min(collected_date) AS first_date, max(collected_date) AS last_date,
    round(sum(value), 6) AS total FROM points GROUP BY marker_key, series_id""")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_points(spark, sf_dir).groupBy("marker_key", "series_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.count("value").alias("n_values"), F.min("collected_date").alias("first_date"), F.max("collected_date").alias("last_date"), F.round(F.sum("value"), 6).alias("total"))


@query(_WITH + """, m AS (
        SELECT profile_id, series_id, marker_key, min(least(value, range_min, range_max)) AS low, max(greatest(value, range_min, range_max)) AS high FROM points GROUP BY ALL)
    SELECT profile_id, series_id, round(coalesce(low - 0.5 * greatest(0.1 * (high - low), 0.1 * abs(high), 1), 0), 9) AS y_min,
        round(coalesce(high + 0.5 * greatest(0.1 * (high - low), 0.1 * abs(high), 1), 1), 9) AS y_max FROM m""")
def y_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ["value", "range_min", "range_max"]
    m = series_points(spark, sf_dir).groupBy("profile_id", "series_id").agg(F.min(F.least(*b)).alias("low"), F.max(F.greatest(*b)).alias("high"))
    pad = 0.5 * F.greatest(0.1 * (F.col("high") - F.col("low")), 0.1 * F.abs("high"), F.lit(1.0))
    return m.select("profile_id", "series_id", F.round(F.coalesce(F.col("low") - pad, F.lit(0.0)), 9).alias("y_min"), F.round(F.coalesce(F.col("high") + pad, F.lit(1.0)), 9).alias("y_max"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series points with x in proportion to time: 0.5 where all times are one."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    whole = Window.partitionBy("user_id", "event_type")
    first, last = F.min("us").over(whole), F.max("us").over(whole)
    return e.withColumn("x", F.when(last == first, 0.5).otherwise((F.col("us") - first) / (last - first))).withColumn("exact", F.col("value") >= 2)


_EVENTS_SQL = """
    e AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER w AS first_us, max(epoch_us(ts)) OVER w AS last_us FROM events WINDOW w AS (PARTITION BY user_id, event_type)),
    g AS (SELECT event_id, user_id, event_type, us, value, value >= 2 AS exact, CASE WHEN last_us = first_us THEN 0.5 ELSE (us - first_us) / CAST(last_us - first_us AS DOUBLE) END AS x FROM e)"""


@query(f"""WITH {_EVENTS_SQL}, l AS (
        SELECT *, first_value(CASE WHEN exact THEN event_id END IGNORE NULLS) OVER w AS first_id, last_value(CASE WHEN exact THEN event_id END IGNORE NULLS) OVER w AS last_id,
            first_value(CASE WHEN exact THEN x END IGNORE NULLS) OVER w AS first_x, last_value(CASE WHEN exact THEN x END IGNORE NULLS) OVER w AS last_x
        FROM g WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(x, 9) AS x, coalesce(event_id = last_id OR (event_id = first_id AND last_x - first_x >= 0.2), FALSE) AS labelled FROM l""")
def trend_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda f, c: f(F.when(F.col("exact"), F.col(c)), True).over(w)
    g = _events(spark, sf_dir).select("event_id", "x", pick(F.first, "event_id").alias("first_id"), pick(F.last, "event_id").alias("last_id"), pick(F.first, "x").alias("fx"), pick(F.last, "x").alias("lx"))
    shown = (F.col("event_id") == F.col("last_id")) | ((F.col("event_id") == F.col("first_id")) & (F.col("lx") - F.col("fx") >= 0.2))
    return g.select("event_id", F.round("x", 9).alias("x"), F.coalesce(shown, F.lit(False)).alias("labelled"))


@query(_WITH + f""", o AS (SELECT *, CAST(row_number() OVER w AS BIGINT) AS pt_ord, lead(collected_date) OVER w AS next_date FROM points WINDOW w AS (PARTITION BY profile_id, series_id {_ORD_SQL}))
    SELECT profile_id, series_id, pt_ord, CASE WHEN pt_ord > 1 THEN collected_date END AS from_date, next_date AS to_date, range_kind,
        round(range_min, 9) AS range_min, round(range_max, 9) AS range_max FROM o WHERE range_kind IS NOT NULL""")
def trend_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stepped reference bands: each printed range holds until the next point; the first reaches back, the last on."""
    p = series_points(spark, sf_dir).withColumn("pt_ord", F.row_number().over(_series()).cast("long")).withColumn("to_date", F.lead("collected_date").over(_series()))
    return p.where(F.col("range_kind").isNotNull()).select("profile_id", "series_id", "pt_ord", F.when(F.col("pt_ord") > 1, F.col("collected_date")).alias("from_date"), "to_date", "range_kind",
                                                           F.round("range_min", 9).alias("range_min"), F.round("range_max", 9).alias("range_max"))


@query(_WITH + f""", d AS (SELECT *, datediff('day', DATE '1970-01-01', collected_date) AS day FROM points),
    s AS (SELECT *, min(day) OVER a AS d0, max(day) OVER a AS d1, min(least(value, range_min, range_max)) OVER a AS lo, max(greatest(value, range_min, range_max)) OVER a AS hi FROM d WINDOW a AS (PARTITION BY profile_id, series_id)),
    g AS (SELECT *, CASE WHEN d1 = d0 THEN 0.5 ELSE (day - d0) / CAST(d1 - d0 AS DOUBLE) END AS x, lo - 0.5 * greatest(0.1 * (hi - lo), 0.1 * abs(hi), 1) AS y0, hi + 0.5 * greatest(0.1 * (hi - lo), 0.1 * abs(hi), 1) AS y1 FROM s),
    o AS (SELECT *, CAST(row_number() OVER w AS BIGINT) AS pt_ord, lead(x) OVER w AS next_x FROM g WINDOW w AS (PARTITION BY profile_id, series_id {_ORD_SQL}))
    SELECT profile_id, series_id, pt_ord, round(CASE WHEN pt_ord = 1 THEN 0 ELSE x END, 9) AS from_x, round(coalesce(next_x, 1), 9) AS to_x,
        round(CASE WHEN range_kind = 'maxOnly' THEN 0 ELSE least(1, greatest(0, (range_min - y0) / (y1 - y0))) END, 9) AS low, round(CASE WHEN range_kind = 'minOnly' THEN 1 ELSE least(1, greatest(0, (range_max - y0) / (y1 - y0))) END, 9) AS high
    FROM o WHERE range_kind IS NOT NULL""")
def trend_band_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stepped bands as shapes in the plot: from point to point in time, clamped to it, one-sided ranges shaded to its edge."""
    whole, b = Window.partitionBy("profile_id", "series_id"), ["value", "range_min", "range_max"]
    p = series_points(spark, sf_dir).withColumn("day", F.unix_date("collected_date"))
    p = p.select("*", F.min("day").over(whole).alias("d0"), F.max("day").over(whole).alias("d1"), F.min(F.least(*b)).over(whole).alias("lo"), F.max(F.greatest(*b)).over(whole).alias("hi"))
    pad = 0.5 * F.greatest(0.1 * (F.col("hi") - F.col("lo")), 0.1 * F.abs("hi"), F.lit(1.0))
    p = p.select("*", F.when(F.col("d1") == F.col("d0"), 0.5).otherwise((F.col("day") - F.col("d0")) / (F.col("d1") - F.col("d0"))).alias("x"), (F.col("lo") - pad).alias("y0"), (F.col("hi") + pad).alias("y1"))
    p = p.withColumn("pt_ord", F.row_number().over(_series()).cast("long")).withColumn("next_x", F.lead("x").over(_series())).where(F.col("range_kind").isNotNull())
    inside = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col("y0")) / (F.col("y1") - F.col("y0"))))
    low, high = F.when(F.col("range_kind") == "maxOnly", 0.0).otherwise(inside("range_min")), F.when(F.col("range_kind") == "minOnly", 1.0).otherwise(inside("range_max"))
    return p.select("profile_id", "series_id", "pt_ord", F.round(F.when(F.col("pt_ord") == 1, 0.0).otherwise(F.col("x")), 9).alias("from_x"), F.round(F.coalesce("next_x", F.lit(1.0)), 9).alias("to_x"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""WITH {_EVENTS_SQL}, i AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, event_type, exact ORDER BY us, event_id) AS island FROM g)
    SELECT user_id, event_type, min(us) AS from_us, max(us) AS to_us, count(*) AS n_points FROM i WHERE exact GROUP BY user_id, event_type, island HAVING count(*) >= 2""")
def trend_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, own = (Window.partitionBy("user_id", "event_type", *c).orderBy("us", "event_id") for c in ([], ["exact"]))
    e = _events(spark, sf_dir).withColumn("island", F.row_number().over(whole) - F.row_number().over(own)).where("exact")
    runs = e.groupBy("user_id", "event_type", "island").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count(F.lit(1)).alias("n_points"))
    return runs.where(F.col("n_points") >= 2).drop("island")


def _status() -> Column:
    return status_of(*[F.col(c) for c in ("value", "comparator", "range_kind", "range_min", "range_max", "range_comparator")])


_STATUS_SQL = """CASE WHEN value IS NULL OR comparator IS NOT NULL OR range_kind IS NULL THEN 'unavailable'
    WHEN (range_kind = 'closed' AND value < range_min) OR (range_kind = 'minOnly' AND value < range_min) THEN 'below'
    WHEN (range_kind = 'closed' AND value > range_max) OR (range_kind = 'maxOnly' AND value >= range_max) THEN 'above' ELSE 'within' END"""


@query(f"WITH {MEASUREMENTS_SQL} SELECT marker_key, {_STATUS_SQL} AS range_status, count(*) AS n FROM measurements GROUP BY ALL")
def range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).groupBy("marker_key", _status().alias("range_status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MEASUREMENTS_SQL}, s AS (
        SELECT *, CASE range_kind WHEN 'closed' THEN greatest(range_max - range_min, 0.1 * greatest(abs(range_min), abs(range_max)), 1) WHEN 'minOnly' THEN greatest(0.25 * abs(range_min), 1)
            WHEN 'maxOnly' THEN greatest(0.25 * abs(range_max), 1) END AS span FROM measurements WHERE range_kind IS NOT NULL AND value IS NOT NULL AND comparator IS NULL
    ), d AS (
        SELECT *, CASE range_kind WHEN 'closed' THEN range_min - 0.25 * span WHEN 'minOnly' THEN range_min - span ELSE range_max - 3 * span END AS lo,
            CASE range_kind WHEN 'closed' THEN range_max + 0.25 * span WHEN 'minOnly' THEN range_min + 3 * span ELSE range_max + span END AS hi FROM s)
    SELECT report_id, marker_key, l_linenumber, round(lo, 9) AS lo, round(hi, 9) AS hi, round(least(1, greatest(0, (value - lo) / (hi - lo))), 9) AS dot,
        CASE WHEN value < lo THEN 'left' WHEN value > hi THEN 'right' END AS side FROM d""")
def range_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, low, high, k = F.col("value"), F.col("range_min"), F.col("range_max"), F.col("range_kind")
    m = measurements(spark, sf_dir).where(k.isNotNull() & v.isNotNull() & F.col("comparator").isNull())
    span = (F.when(k == "closed", F.greatest(high - low, 0.1 * F.greatest(F.abs(low), F.abs(high)), F.lit(1.0))).when(k == "minOnly", F.greatest(0.25 * F.abs(low), F.lit(1.0)))
            .otherwise(F.greatest(0.25 * F.abs(high), F.lit(1.0))))
    m = m.withColumn("span", span)
    s = F.col("span")
    m = m.withColumn("lo", F.when(k == "closed", low - 0.25 * s).when(k == "minOnly", low - s).otherwise(high - 3 * s))
    m = m.withColumn("hi", F.when(k == "closed", high + 0.25 * s).when(k == "minOnly", low + 3 * s).otherwise(high + s))
    dot = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return m.select("report_id", "marker_key", "l_linenumber", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round(dot, 9).alias("dot"),
                    F.when(v < F.col("lo"), "left").when(v > F.col("hi"), "right").alias("side"))


_LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"


@query(f"""WITH {MEASUREMENTS_SQL}, s AS (SELECT *, {_STATUS_SQL} AS rs FROM measurements)
    SELECT report_id, marker_key, l_linenumber, rs AS range_status, CAST(row_number() OVER (PARTITION BY report_id
        ORDER BY CASE WHEN rs IN ('below', 'above') THEN 0 WHEN status = 'missing' THEN 2 ELSE 1 END, {_LINE}) AS BIGINT) AS place FROM s""")
def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("range_status", _status())
    rank = F.when(F.col("range_status").isin("below", "above"), 0).when(F.col("status") == "missing", 2).otherwise(1)
    w = Window.partitionBy("report_id").orderBy(rank, *LINE_ORDER)
    return m.select("report_id", "marker_key", "l_linenumber", "range_status", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {MEASUREMENTS_SQL}, f AS (SELECT *, CASE WHEN value > 45 THEN 0 ELSE 2 END + CASE WHEN comparator IS NOT NULL OR status = 'missing' THEN 0 ELSE 1 END AS weight FROM measurements)
    SELECT report_id, marker_key, l_linenumber, weight, CAST(row_number() OVER (PARTITION BY report_id ORDER BY weight, {_LINE}) AS BIGINT) AS place FROM f""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows first, then those of low confidence, then the order of the source."""
    flagged, low = F.col("value") > 45, F.col("comparator").isNotNull() | (F.col("status") == "missing")
    m = measurements(spark, sf_dir).withColumn("weight", F.when(flagged, 0).otherwise(2) + F.when(low, 0).otherwise(1))
    w = Window.partitionBy("report_id").orderBy("weight", *LINE_ORDER)
    return m.select("report_id", "marker_key", "l_linenumber", "weight", F.row_number().over(w).cast("long").alias("place"))


@query(_WITH + """, c AS (SELECT marker_key, profile_id, count(DISTINCT series_id) AS n_series FROM points GROUP BY ALL)
    SELECT p.profile_id, p.report_id, p.marker_key, p.series_id, n_series > 1 AS split_unit, count(*) AS n FROM points p JOIN c USING (profile_id, marker_key) GROUP BY ALL""")
def panel_series_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series_points(spark, sf_dir)
    of_report = p.groupBy("profile_id", "marker_key", "series_id", "report_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("profile_id", "marker_key")
    split = F.min("series_id").over(w) != F.max("series_id").over(w)
    return of_report.select("profile_id", "report_id", "marker_key", "series_id", split.alias("split_unit"), "n")


@query(f"""WITH {_EVENTS_SQL}, q AS (SELECT *, abs(x - 0.5) AS dx FROM g)
    SELECT user_id, event_type, arg_min(event_id, (dx, us, event_id)) AS event_id, round(min(dx), 9) AS dx FROM q GROUP BY ALL""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("dx", F.abs(F.col("x") - 0.5))
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("dx", "us", "event_id")).alias("event_id"), F.round(F.min("dx"), 9).alias("dx"))


@query("""
    WITH p AS (SELECT user_id, event_type, event_id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_ts FROM events)
    SELECT event_id, event_type, epoch_us(next_ts) - epoch_us(ts) AS gap_us FROM p""")
def barrier_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    return e.select("event_id", "event_type", (F.lead("us").over(w) - F.col("us")).alias("gap_us"))


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading_id FROM events""")
def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join without a join: the latest heading at or above each row, carried forward."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w).alias("heading_id"))
