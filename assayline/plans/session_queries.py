"""Intake, review-session and display queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intake
from ..sources.labview import LINE_ORDER, MEASUREMENTS_SQL, measurements, reports, table
from .registry import query, values

_LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"


@query("""
    WITH f AS (SELECT conv_id // 4 AS batch_id, conv_id * 100 + turn AS source_index, role <> 'system' AS supported, length(text) * 400000 AS n_bytes, CASE WHEN (conv_id + turn) % 11 <> 0 THEN CAST(length(text) % 29 AS BIGINT) END AS pages,
        (conv_id * 3 + turn) % 8 <> 0 AS valid FROM conversations),
    c AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n_files, sum(CASE WHEN supported AND n_bytes <= 52428800 THEN coalesce(pages, 0) ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS so_far FROM f),
    x AS (SELECT *, min(CASE WHEN so_far > 100 THEN source_index END) OVER (PARTITION BY batch_id) AS crossing FROM c)
    SELECT batch_id, source_index, CASE WHEN n_files > 20 THEN 'too-many-files' WHEN source_index > crossing THEN 'unread' WHEN source_index = crossing THEN 'page-budget' WHEN NOT supported THEN 'unsupported-type'
        WHEN n_bytes > 52428800 THEN 'too-large' WHEN pages IS NULL THEN 'decode-failed' WHEN NOT valid THEN 'not-a-document' ELSE 'accepted' END AS outcome FROM x""")
def batch_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each file of a batch; after the file that crosses the page budget nothing is read."""
    c = table(spark, sf_dir, "conversations")
    n, conv, turn = F.length("text").cast("long"), F.col("conv_id"), F.col("turn")
    files = c.select(F.floor(conv / 4).alias("batch_id"), (conv * 100 + turn).alias("source_index"), (F.col("role") != "system").alias("supported"), (n * 400000).alias("n_bytes"),
                     F.when((conv + turn) % 11 != 0, n % 29).alias("pages"), ((conv * 3 + turn) % 8 != 0).alias("valid"))
    return intake.route(files).select("batch_id", "source_index", "outcome")


@query("""
    WITH w AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM conversations),
    f AS (SELECT conv_id, turn, unnest(list_transform(w, lambda x, i: {'frag': i, 'text': x, 'x': CAST(12 * i + CASE WHEN i % 3 = 0 THEN 0.25 ELSE 0 END AS DOUBLE), 'w': CAST(CASE WHEN i % 3 = 1 THEN 12 WHEN i % 3 = 2 THEN 12.5 ELSE 8 END AS DOUBLE),
        'b': 700 + 0.004 * (i % 4)})) AS f FROM w),
    k AS (SELECT conv_id, turn, f.frag AS frag, f.text AS text, f.x AS x, f.w AS w, f.b AS b FROM f WHERE f.text <> ''),
    l AS (SELECT conv_id, turn, list([{'text': text, 'x': x, 'w': w, 'b': b}] ORDER BY frag) AS l FROM k GROUP BY ALL),
    j AS (SELECT conv_id, turn, list_reduce(l, lambda a, n: CASE WHEN abs(a[len(a)].b - n[1].b) < 0.01 AND n[1].x >= a[len(a)].x AND n[1].x - (a[len(a)].x + a[len(a)].w) < 0.5
        THEN list_append(a[1:len(a) - 1], {'text': a[len(a)].text || n[1].text, 'x': a[len(a)].x, 'w': n[1].x + n[1].w - a[len(a)].x, 'b': a[len(a)].b}) ELSE list_append(a, n[1]) END) AS r FROM l)
    SELECT 'c' || conv_id AS source_id, CAST(turn AS INTEGER) AS page, CAST(i AS INTEGER) AS item, r[i].text AS text, round(r[i].x, 6) AS x, round(r[i].w, 6) AS w FROM j, unnest(range(1, len(r) + 1)) t(i)""")
def fragment_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words set as fragments, some touching, on baselines that drift; joined back to items."""
    words = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_id"), F.col("turn").cast("int").alias("page"),
                                                         F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), " ", -1)).alias("i", "text"))
    i = F.col("i") + 1
    f = words.select("source_id", "page", i.alias("frag"), "text", (12 * i + F.when(i % 3 == 0, 0.25).otherwise(0.0)).cast("double").alias("x"), (F.lit(700) + F.lit(0.004) * (i % 4)).alias("baseline"),
                     F.when(i % 3 == 1, 12.0).when(i % 3 == 2, 12.5).otherwise(8.0).alias("w"), F.lit(709.0).alias("ascent"), F.lit(698.0).alias("descent"))
    return intake.rejoin(f).select("source_id", "page", "item", "text", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query(f"""WITH {MEASUREMENTS_SQL} SELECT report_id, l_linenumber, marker_key,
    CASE WHEN value IS NULL THEN '' ELSE coalesce(comparator, '') || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ' ' || unit END AS printed_value,
    CASE range_kind WHEN 'closed' THEN regexp_replace(CAST(range_min AS VARCHAR), '\\.0$', '') || '–' || regexp_replace(CAST(range_max AS VARCHAR), '\\.0$', '')
        WHEN 'minOnly' THEN range_comparator || regexp_replace(CAST(range_min AS VARCHAR), '\\.0$', '') WHEN 'maxOnly' THEN range_comparator || regexp_replace(CAST(range_max AS VARCHAR), '\\.0$', '') ELSE '' END AS printed_range
    FROM measurements""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and ranges as the screens print them: whole numbers without a fraction, closed ranges with an en dash."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    k = F.col("range_kind")
    value = F.when(F.col("value").isNull(), "").otherwise(F.concat(F.coalesce("comparator", F.lit("")), number("value"), F.lit(" "), "unit"))
    bounds = (F.when(k == "closed", F.concat(number("range_min"), F.lit("–"), number("range_max"))).when(k == "minOnly", F.concat("range_comparator", number("range_min")))
              .when(k == "maxOnly", F.concat("range_comparator", number("range_max"))).otherwise(""))
    return measurements(spark, sf_dir).select("report_id", "l_linenumber", "marker_key", value.alias("printed_value"), bounds.alias("printed_range"))


@query(f"""WITH {MEASUREMENTS_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY report_id, marker_key) AS n, row_number() OVER (PARTITION BY report_id, marker_key ORDER BY {_LINE}) AS k FROM measurements)
    SELECT report_id, marker_key, l_linenumber, value, n > 1 AS was_contested FROM r WHERE n = 1 OR (k = 1 AND l_partkey % 2 = 0)""")
def measurements_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session commits: uncontested rows, the chosen row of each resolved conflict; unresolved ones are dropped.

    Conflicts over even parts count as resolved in favour of their first row.
    """
    key = Window.partitionBy("report_id", "marker_key")
    m = measurements(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(key)).withColumn("k", F.row_number().over(key.orderBy(*LINE_ORDER)))
    kept = m.where((F.col("n") == 1) | ((F.col("k") == 1) & (F.col("l_partkey") % 2 == 0)))
    return kept.select("report_id", "marker_key", "l_linenumber", "value", (F.col("n") > 1).alias("was_contested"))


@query(f"""WITH {MEASUREMENTS_SQL}, c AS (SELECT report_id, count(*) AS n FROM (SELECT report_id, marker_key FROM measurements GROUP BY ALL HAVING count(*) > 1) GROUP BY report_id),
    u AS (SELECT report_id, count(*) FILTER (WHERE range_kind IS NULL) AS unapproved, count(*) FILTER (WHERE comparator IS NOT NULL) AS censored FROM measurements GROUP BY report_id)
    SELECT u.report_id, coalesce(c.n, 0) AS open_conflicts, unapproved, censored, coalesce(c.n, 0) = 0 AND unapproved = 0 AS gate_open FROM u LEFT JOIN c ON u.report_id = c.report_id""")
def blocker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blockers of a report in two aggregations on nested keys: the second needs no new shuffle of rows."""
    m = measurements(spark, sf_dir).groupBy("report_id", "marker_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("range_kind").isNull()).alias("u"), F.count_if(F.col("comparator").isNotNull()).alias("c"))
    g = m.groupBy("report_id").agg(F.count_if(F.col("n") > 1).alias("open_conflicts"), F.sum("u").alias("unapproved"), F.sum("c").alias("censored"))
    return g.withColumn("gate_open", (F.col("open_conflicts") == 0) & (F.col("unapproved") == 0))


@query("""
    SELECT o_custkey AS profile_id, count(*) AS n_reports, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_by_date,
        max(o_orderkey) AS last_stored FROM orders GROUP BY 1""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two different latest reports: by date, and the last one stored."""
    return reports(spark, sf_dir).groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n_reports"), F.min("collected_date").alias("first_date"), F.max("collected_date").alias("last_date"),
        F.max_by("report_id", F.struct("collected_date", "report_id")).alias("latest_by_date"), F.max("report_id").alias("last_stored"))


@query("""
    SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n_assets, substr(sha256(string_agg(url, chr(10) ORDER BY url)), 1, 12) AS revision FROM pages
    WHERE NOT regexp_matches(url, '\\.(png|jpg)$') GROUP BY 1""")
def asset_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content revision for each host: the hash of its sorted asset list."""
    p = table(spark, sf_dir, "pages").where(~F.col("url").rlike(r"\.(png|jpg)$"))
    g = p.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n_assets"), F.array_sort(F.collect_list("url")).alias("u"))
    return g.select("host", "n_assets", F.substring(F.sha2(F.array_join("u", "\n"), 256), 1, 12).alias("revision"))


@query(f"""WITH {MEASUREMENTS_SQL} SELECT report_id, marker_key, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'categorical' ELSE status END AS status,
    CASE WHEN l_partkey % 9 <> 0 THEN value END AS value, CASE WHEN l_partkey % 9 <> 0 THEN unit END AS unit, CASE WHEN l_partkey % 9 <> 0 THEN range_kind END AS range_kind, CASE WHEN l_partkey % 9 = 0 THEN 'negative' END AS text_value FROM measurements""")
def status_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a row's status cannot carry become null: a categorical row keeps neither value, unit nor range."""
    cat = F.col("l_partkey") % 9 == 0
    return measurements(spark, sf_dir).select("report_id", "marker_key", "l_linenumber", F.when(cat, "categorical").otherwise(F.col("status")).alias("status"),
                                              *[F.when(~cat, F.col(c)).alias(c) for c in ("value", "unit", "range_kind")], F.when(cat, "negative").alias("text_value"))


@query("""
    WITH c AS (SELECT l_orderkey AS id, string_agg(l_partkey || ':' || l_quantity, ',' ORDER BY l_partkey, l_quantity, l_suppkey) AS body FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
    d AS (SELECT l_orderkey AS id, string_agg(l_partkey || ':' || CASE WHEN l_orderkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END, ',' ORDER BY l_partkey, l_quantity, l_suppkey) AS body FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT c.id AS report_id, c.body = d.body AS same_content FROM c JOIN d ON c.id = d.id""")
def structural_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports equal in content whatever the order of their measurements: sorted arrays, compared once."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "O")
    changed = F.when(F.col("l_orderkey") % 11 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    body = lambda q: F.array_sort(F.collect_list(F.struct("l_partkey", F.col("l_quantity").alias("o"), "l_suppkey", q.alias("q"))))
    flat = lambda c: F.transform(c, lambda m: F.struct(m["l_partkey"], m["q"]))
    g = li.groupBy(F.col("l_orderkey").alias("report_id")).agg(body(F.col("l_quantity")).alias("a"), body(changed).alias("b"))
    return g.select("report_id", flat(F.col("a")).eqNullSafe(flat(F.col("b"))).alias("same_content"))


@query(f"""WITH {MEASUREMENTS_SQL}, d AS (SELECT report_id // 8 AS target, report_id, count(*) AS n FROM measurements GROUP BY ALL)
    SELECT target, string_agg(CAST(report_id AS VARCHAR), ',' ORDER BY report_id) AS drafts, CAST(sum(n) AS BIGINT) AS n_measurements FROM d GROUP BY target""")
def append_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts aimed at one stored report, put together in order; counts first, so rows are shuffled once."""
    d = measurements(spark, sf_dir).groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    g = d.groupBy(F.floor(F.col("report_id") / 8).alias("target")).agg(F.array_sort(F.collect_list("report_id")).alias("d"), F.sum("n").alias("n_measurements"))
    return g.select("target", F.array_join(F.col("d").cast("array<string>"), ",").alias("drafts"), "n_measurements")


@query(f"""WITH {MEASUREMENTS_SQL} SELECT report_id, string_agg(marker_key, ',' ORDER BY {_LINE}) AS unrecognised FROM measurements WHERE range_kind IS NULL GROUP BY report_id""")
def unrecognised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).where(F.col("range_kind").isNull())
    listed = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "marker_key")))
    return m.groupBy("report_id").agg(F.array_join(F.transform(listed, lambda s: s["marker_key"]), ",").alias("unrecognised"))


@query("""
    WITH b(ord, y, h) AS (VALUES (1, 100, 40), (2, 130, 10), (3, 400, NULL)), t AS (SELECT turn, conv_id, turn * 50 AS y, length(text) % 60 AS h FROM conversations)
    SELECT conv_id, turn, ord FROM t JOIN b ON b.h IS NULL OR (t.y < b.y + b.h AND b.y < t.y + t.h)""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose height overlaps a finding's box, or the whole page where a finding has no box."""
    b = F.broadcast(values(spark, "(1, 100, 40), (2, 130, 10), (3, 400, CAST(NULL AS INT))", "ord, by, bh"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 50).alias("y"), (F.length("text") % 60).alias("h"))
    overlap = (F.col("y") < F.col("by") + F.col("bh")) & (F.col("by") < F.col("y") + F.col("h"))
    return t.join(b, F.col("bh").isNull() | overlap).select("conv_id", "turn", "ord")
