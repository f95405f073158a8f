"""Profiles: matching keys, merge plans, overlays, gates, constraints and session edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexical import derived_key, normalise_label
from ..operators import profile, review
from ..sources.labview import LINE_ORDER, MEASUREMENTS_SQL, draft_rows, measurements, reports, table
from .registry import query, values

_LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"


@query("""
    WITH known AS (SELECT lower(p_name) AS label, min(p_partkey) AS ord FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
    SELECT p_partkey, coalesce('p' || ord, 'x:' || regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g')) AS marker_key FROM part LEFT JOIN known ON lower(p_name) = label""")
def marker_key_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to keys: the registry's if it knows the label, else a derived one; never null."""
    part = table(spark, sf_dir, "part").withColumn("label", normalise_label(F.col("p_name")))
    known = part.where(F.col("p_partkey") % 2 == 0).groupBy("label").agg(F.min("p_partkey").alias("ord"))
    return part.join(known, "label", "left").select("p_partkey", F.coalesce(F.concat(F.lit("p"), F.col("ord").cast("string")), derived_key(F.col("p_name"))).alias("marker_key"))


@query("""
    WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) || ' ' AS t FROM documents),
    b AS (SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS a FROM benchmark)
    SELECT doc_id, min(item_id) AS item_id, count(DISTINCT item_id) AS n_items FROM d JOIN b ON a <> '' AND contains(t, ' ' || a || ' ') GROUP BY doc_id""")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which dictionary texts a document holds as whole words; the first in registry order wins."""
    from ..operators.match import contained

    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("alias"))
    return contained(docs, items).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))


_NAMES = "(0, 'small ring', 'SR'), (1, 'large', 'LG'), (2, 'copper', 'CU'), (3, 'red bolt', 'RB')"


@query(f"""
    WITH a(ord, alias, code) AS (VALUES {_NAMES}), c AS (SELECT p_partkey, lower(p_name) AS label, upper(substr(p_type, 1, 2)) AS code FROM part),
    h AS (SELECT p_partkey, 1 AS tier, ord FROM c JOIN a ON c.code = a.code UNION ALL SELECT p_partkey, 2, ord FROM c JOIN a ON c.label = a.alias
        UNION ALL SELECT p_partkey, 3, min(ord) FROM c JOIN a ON contains(' ' || label || ' ', ' ' || alias || ' ') GROUP BY p_partkey)
    SELECT p_partkey, min(tier) AS tier, arg_min(ord, (tier, ord)) AS ord FROM h GROUP BY p_partkey""")
def tier_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviation, exact alias, contained alias: the first tier with a hit wins."""
    a = F.broadcast(values(spark, _NAMES, "ord, alias, code"))
    c = table(spark, sf_dir, "part").select("p_partkey", normalise_label(F.col("p_name")).alias("label"), F.upper(F.substring("p_type", 1, 2)).alias("code"))
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    tier = F.when(c["code"] == a["code"], 1).when(c["label"] == a["alias"], 2).otherwise(3)
    hit = (c["code"] == a["code"]) | (c["label"] == a["alias"]) | F.contains(pad(c["label"]), pad(a["alias"]))
    best = c.join(a, hit).groupBy("p_partkey").agg(F.min(F.struct(tier.alias("tier"), F.col("ord"))).alias("b"))
    return best.select("p_partkey", "b.tier", "b.ord")


@query("""
    WITH stored AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
    arriving AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 2 = 0)
    SELECT a.id AS report_id, CASE WHEN s.id IS NULL THEN 'addition' WHEN s.v = a.v THEN 'duplicate' ELSE 'report-id' END AS outcome FROM arriving a LEFT JOIN stored s ON a.id = s.id""")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), "o_custkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    stored, arriving = o.where(F.col("report_id") % 3 != 0), o.where(F.col("report_id") % 2 == 0)
    arriving = arriving.withColumn("v", F.when(F.col("report_id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return profile.merge_plan(stored, arriving, "report_id").select("report_id", "outcome")


@query("""
    WITH o AS (SELECT o_orderkey AS id, o_custkey % 20 AS p, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 <> 0 AS timed FROM orders)
    SELECT a.id AS added_id, s.id AS stored_id, a.d AS day FROM o a JOIN o s ON a.p = s.p AND a.d = s.d AND a.id % 3 = 0 AND s.id % 3 <> 0 AND NOT (a.timed AND s.timed)""")
def same_day_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).withColumn("profile_id", F.col("profile_id") % 20).withColumn("time", F.when(F.col("report_id") % 4 != 0, "10:00"))
    stored, added = r.where(F.col("report_id") % 3 != 0), r.where(F.col("report_id") % 3 == 0)
    return profile.same_day_conflicts(stored, added)


@query("""
    WITH s AS (SELECT o_orderkey AS id, o_totalprice AS v, 'stored' AS origin FROM orders WHERE o_orderkey % 3 <> 0),
    u AS (SELECT o_orderkey AS id, round(o_totalprice * 2, 4) AS v FROM orders WHERE o_orderkey % 6 IN (0, 1))
    SELECT s.id AS report_id, coalesce(u.v, s.v) AS v, CASE WHEN u.id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM s LEFT JOIN u ON s.id = u.id
    UNION ALL SELECT u.id, u.v, 'added' FROM u WHERE u.id NOT IN (SELECT id FROM s)""")
def overlay_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_totalprice").alias("v"))
    changed = o.where((F.col("report_id") % 6).isin(0, 1)).withColumn("v", F.round(F.col("v") * 2, 4))
    return profile.overlay(o.where(F.col("report_id") % 3 != 0), changed, "report_id")


@query("""
    SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_target,
        NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS free_of_conflict FROM customer""")
def target_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gates in one aggregation of the many side instead of a semi and an anti join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("t"), F.bool_or(F.col("o_totalprice") > 400000).alias("x"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("t", F.lit(False)).alias("has_target"), (~F.coalesce("x", F.lit(False))).alias("free_of_conflict"))


@query(f"""WITH {MEASUREMENTS_SQL} SELECT report_id, marker_key, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY {_LINE}) AS lines
    FROM measurements GROUP BY ALL HAVING count(*) >= 2""")
def duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.duplicate_conflicts(measurements(spark, sf_dir), ["report_id", "marker_key"], LINE_ORDER)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n_anchors FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def competing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_anchors"))
    return g.where(F.col("n_anchors") > 1)


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL""")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("""
    WITH c AS (SELECT o_custkey AS profile_id, CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) AS timed,
            count(DISTINCT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 24 END) AS times FROM orders GROUP BY ALL)
    SELECT profile_id, d AS collected_date, n AS n_reports, n < 2 OR (timed = n AND times = n) AS allowed FROM c""")
def same_day_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).withColumn("time", F.when(F.col("report_id") % 4 != 0, F.concat(F.col("report_id") % 24, F.lit(":00"))))
    return profile.same_day_precision(r)


@query(f"""WITH {MEASUREMENTS_SQL} SELECT 'measurement' AS subject, report_id, marker_key, count(*) AS n FROM measurements GROUP BY report_id, marker_key HAVING count(*) > 1
    UNION ALL SELECT 'report', report_id, NULL, count(*) FROM reports GROUP BY report_id HAVING count(*) > 1""")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.uniqueness_violations(reports(spark, sf_dir), measurements(spark, sf_dir))


@query(f"""WITH {MEASUREMENTS_SQL}, d AS (SELECT * REPLACE (CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 1.5 ELSE value END AS value, CASE WHEN l_suppkey % 9 = 0 THEN range_min + 50 ELSE range_min END AS range_min,
            CASE l_linenumber WHEN 6 THEN 'bad key!' WHEN 7 THEN '' ELSE marker_key END AS marker_key, CASE WHEN l_partkey % 11 = 0 THEN '=' ELSE comparator END AS comparator,
            CASE WHEN l_suppkey % 7 = 0 THEN '<' ELSE range_comparator END AS range_comparator, CASE l_linenumber WHEN 5 THEN 'odd' WHEN 4 THEN 'categorical' ELSE status END AS status) FROM measurements),
    v AS (SELECT report_id, unnest(list_filter([CASE WHEN status NOT IN ('value', 'categorical', 'missing') THEN 'status' END, CASE WHEN status = 'categorical' AND value IS NOT NULL THEN 'categorical-with-value' END,
            CASE WHEN comparator IS NOT NULL AND (comparator NOT IN ('<', '<=', '>', '>=') OR status <> 'value') THEN 'comparator' END, CASE WHEN range_kind = 'minOnly' AND range_comparator NOT IN ('>', '>=') THEN 'range-direction' END, CASE WHEN status = 'value' AND value IS NULL THEN 'value-missing' END, CASE WHEN status = 'missing' AND value IS NOT NULL THEN 'missing-with-value' END,
            CASE WHEN range_kind = 'closed' AND range_min > range_max THEN 'range-order' END, CASE WHEN NOT regexp_matches(marker_key, '^(x:)?[a-z0-9-]+$') THEN 'marker-key' END, CASE WHEN marker_key = '' THEN 'empty-key' END], lambda x: x IS NOT NULL)) AS rule FROM d)
    SELECT report_id, rule, count(*) AS n FROM v GROUP BY ALL""")
def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of measurements that were damaged in several ways."""
    m, part, line = measurements(spark, sf_dir), F.col("l_partkey"), F.col("l_linenumber")
    damaged = m.withColumn("value", F.when(part % 13 != 0, F.when(part % 7 == 0, 1.5).otherwise(F.col("value")))).withColumn("range_min", F.when(F.col("l_suppkey") % 9 == 0, F.col("range_min") + 50).otherwise(F.col("range_min")))
    damaged = damaged.withColumn("marker_key", F.when(line == 6, "bad key!").when(line == 7, "").otherwise(F.col("marker_key")))
    damaged = damaged.withColumn("comparator", F.when(part % 11 == 0, "=").otherwise(F.col("comparator"))).withColumn("range_comparator", F.when(F.col("l_suppkey") % 7 == 0, "<").otherwise(F.col("range_comparator")))
    damaged = damaged.withColumn("status", F.when(line == 5, "odd").when(line == 4, "categorical").otherwise(F.col("status")))
    return profile.measurement_violations(damaged).groupBy("report_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax > 0.07 AND l_quantity > 40)
    SELECT l_partkey, CASE WHEN l_partkey IN (SELECT l_partkey FROM b) THEN 'both' ELSE 'first' END AS origin FROM a UNION ALL SELECT l_partkey, 'second' FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM a)""")
def union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two distinct sets in one aggregation."""
    li = table(spark, sf_dir, "lineitem")
    first, second = F.bool_or(F.col("l_returnflag") == "R"), F.bool_or((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 40))
    g = li.groupBy("l_partkey").agg(first.alias("a"), second.alias("b")).where(F.col("a") | F.col("b"))
    return g.select("l_partkey", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("origin"))


@query("""
    SELECT 'part' AS registry, query, p_partkey, CAST(place AS BIGINT) AS place FROM (
        SELECT q.query, p_partkey, row_number() OVER (PARTITION BY q.query ORDER BY p_partkey) AS place FROM part JOIN (VALUES ('ring'), ('BLUE'), (''), ('zzz')) q(query)
            ON trim(q.query) <> '' AND contains(lower(p_name), lower(q.query))) WHERE place <= 8""")
def registry_search_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.broadcast(values(spark, "('ring'), ('BLUE'), (''), ('zzz')", "query").where(F.trim("query") != ""))
    p = table(spark, sf_dir, "part").select("p_partkey", normalise_label(F.col("p_name")).alias("name"))
    w = Window.partitionBy("query").orderBy("p_partkey")
    hits = p.join(q, F.contains(F.col("name"), normalise_label(F.col("query")))).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= 8)
    return hits.select(F.lit("part").alias("registry"), "query", "p_partkey", "place")


@query("""
    WITH r AS (SELECT conv_id, turn, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations),
    c AS (SELECT conv_id, min(CASE WHEN used > 800 THEN turn END) AS cut FROM r GROUP BY conv_id)
    SELECT r.conv_id, turn, chars, CAST(used AS BIGINT) AS used FROM r JOIN c ON r.conv_id = c.conv_id WHERE cut IS NULL OR turn < cut""")
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources up to the one that crosses the budget; that one and all later ones are left out."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return r.withColumn("used", F.sum("chars").over(w)).where(F.col("used") <= 800)


@query("""
    SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 7 = 0 THEN 'not-json' WHEN o_orderkey % 7 = 1 THEN 'not-a-profile' WHEN o_orderkey % 7 = 2 THEN 'version' ELSE 'ok' END AS outcome,
        CASE WHEN o_orderkey % 7 > 2 THEN o_totalprice END AS total FROM orders""")
def profile_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as versioned JSON, some damaged, and read back with ordered error codes."""
    from ..sources import profile_file

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("total"))
    k = F.col("report_id") % 7
    body = profile_file.write(F.struct("report_id", F.col("date").cast("string").alias("date"), "total"), F.when(k == 2, 2).otherwise(1), F.when(k == 1, "other").otherwise(profile_file.FORMAT))
    text = F.when(k == 0, F.concat(body, F.lit("}{"))).otherwise(body)
    read = profile_file.read(o.select("report_id", F.encode(text, "UTF-8").alias("content")), "report_id long, date string, total double")
    return read.select("report_id", "outcome", F.col("profile.total").alias("total"))


_DAMAGE = """CASE o_orderkey % 14 WHEN 1 THEN 'profile.schemaVersion|schema-version' WHEN 2 THEN 'profile.id|id' WHEN 3 THEN 'profile.reports[0].collectedAt.date|date' WHEN 4 THEN 'profile.reports[0].measurements[0].status|status'
        WHEN 5 THEN 'profile.reports[0].measurements[0].value|value-missing' WHEN 6 THEN 'profile.reports[0].measurements[0].referenceRange|range-order' WHEN 7 THEN 'profile.reports[0].measurements|repeated-marker' WHEN 8 THEN 'profile.reports[1].id|repeated-report'
        WHEN 9 THEN 'profile.reports[r' || o_orderkey || '].measurements[x:m1].label|label-email' WHEN 10 THEN 'profile.reports[0].measurements[0].value|number' WHEN 11 THEN 'profile.reports[0].collectedAt|same-day' WHEN 12 THEN 'profile.reports[0].measurements|too-many' END"""


@query(f"""
    WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT o_orderkey AS report_id, {_DAMAGE} AS fault FROM orders JOIN n ON l_orderkey = o_orderkey WHERE o_orderkey % 14 <> 13),
    r AS (SELECT report_id, CASE WHEN fault IS NULL THEN 'ok' ELSE 'invalid-profile' END AS outcome, split_part(fault, '|', 1) AS path, split_part(fault, '|', 2) AS rule FROM d)
    SELECT report_id, outcome, path, rule FROM r UNION ALL SELECT o_orderkey, 'version', NULL, NULL FROM orders JOIN n ON l_orderkey = o_orderkey WHERE o_orderkey % 14 = 13""")
def validated_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole profiles as JSON files, most of them damaged, read back: the first broken rule by document order, with its path."""
    from ..sources import profile_file

    k = F.col("report_id") % 14
    m = draft_rows(spark, sf_dir).where(F.col("row_no").isNotNull())
    first = F.col("row_no") == 1
    value = F.when((k == 5) & first, F.lit(None).cast("double")).otherwise(F.coalesce("value", F.lit(1.0)))
    # one text for a number makes a JSON string, so numbers are written as they are and the damaged one in quotes
    body = F.to_json(F.struct(F.concat(F.lit("x:m"), "row_no").alias("markerKey"), F.when((k == 9) & first, "a.b@c.gr").otherwise("some label").alias("label"), F.when((k == 4) & first, "odd").otherwise("value").alias("status"), value.alias("value"),
                              F.lit(None).cast("string").alias("comparator"), F.lit("mg/dL").alias("unit"), F.struct(F.lit("closed").alias("kind"), F.when((k == 6) & first, 9).otherwise(1).alias("min"), F.lit(5).alias("max")).alias("referenceRange"),
                              (F.col("row_no") - 1).alias("sourceOrder")), {"ignoreNullFields": "false"})
    body = F.when((k == 10) & first, F.regexp_replace(body, r'"value":([0-9.]+)', '"value":"$1"')).otherwise(body)
    g = m.withColumn("body", body).groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "body"))), lambda x: x["body"]).alias("l"))
    lists = F.when(k == 7, F.concat("l", F.slice("l", 1, 1))).when(k == 12, F.concat("l", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.replace(F.col("l")[0], F.lit("x:m1"), F.concat(F.lit("x:n"), i.cast("string")))))).otherwise(F.col("l"))
    at = F.when(k == 3, "2024-02-30").otherwise("2024-02-29")
    report = lambda id_: F.concat(F.lit('{"id":"'), id_, F.lit('","collectedAt":{"date":"'), at, F.lit('","time":null,"precision":"day"},"measurements":['), F.array_join(lists, ","), F.lit("]}"))
    name = F.concat(F.lit("r"), F.col("report_id").cast("string"))
    reports_ = F.when(k == 8, F.concat(report(name), F.lit(","), report(name))).when(k == 11, F.concat(report(name), F.lit(","), report(F.concat(name, F.lit("b"))))).otherwise(report(name))
    text = F.concat(F.lit('{"format":"' + profile_file.FORMAT + '","v":'), F.when(k == 13, "2").otherwise("1"), F.lit(',"profile":{"schemaVersion":'), F.when(k == 1, "2").otherwise("1"), F.lit(',"id":"'), F.when(k == 2, "").otherwise("p"), F.lit('","reports":['), reports_, F.lit("]}}"))
    # files are far larger than the rows that they are made of here, so the small shuffle before them must not be drawn into one task
    files = g.select("report_id", F.encode(text, "UTF-8").alias("content")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "report_id")
    return profile_file.read_validated(files, "report_id").select("report_id", "outcome", "path", "rule")


@query(f"""WITH {MEASUREMENTS_SQL}, e AS (SELECT report_id, CASE WHEN l_partkey % 10 = 3 THEN 'm' || (l_partkey - 1) ELSE marker_key END AS marker_key FROM measurements)
    SELECT report_id, marker_key, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 2""")
def review_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    changed = review.reassign(m, F.col("l_partkey") % 10 == 3, F.concat(F.lit("m"), (F.col("l_partkey") - 1).cast("string")))
    return review.duplicate_conflicts(changed, ["report_id", "marker_key"], LINE_ORDER).select("report_id", "marker_key", "n")


@query(f"""WITH {MEASUREMENTS_SQL}, k AS (SELECT * FROM measurements WHERE status <> 'missing')
    SELECT report_id, marker_key, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY {_LINE}) AS lines FROM k GROUP BY ALL HAVING count(*) >= 2""")
def review_delete_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.duplicate_conflicts(review.delete(measurements(spark, sf_dir), F.col("status") == "missing"), ["report_id", "marker_key"], LINE_ORDER)


@query("""
    WITH r AS (SELECT o_custkey AS profile_id, CAST(o_orderdate AS DATE) AS collected_date, o_orderkey AS report_id FROM orders)
    SELECT profile_id, report_id, collected_date, CASE WHEN count(*) OVER w > 1 THEN lpad(CAST(row_number() OVER (PARTITION BY profile_id, collected_date ORDER BY report_id) - 1 AS VARCHAR), 2, '0') || ':00' END AS time
    FROM r WINDOW w AS (PARTITION BY profile_id, collected_date)""")
def resolve_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.resolve_same_day(reports(spark, sf_dir)).select("profile_id", "report_id", "collected_date", "time")


@query("""SELECT o_custkey AS profile_id, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_left, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS removed FROM orders GROUP BY 1""")
def remove_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("profile_id")).agg(F.count_if(~gone).alias("n_left"), (F.count_if(gone) > 0).alias("removed"))


_ACTION_NAMES = ["profile-loaded", "extract-started", "extract-progressed", "review-ready", "extract-started", "review-ready", "commit-started", "commit-succeeded", "review-updated", "review-empty", "cancelled", "cleared", "failed",
                 "review-ready", "commit-started", "commit-succeeded"]


@query(f"""
    WITH a AS (SELECT user_id AS session, {_ACTION_NAMES}[1 + CAST((event_id * 7 + floor(value)) % 16 AS INTEGER)] AS action, ts, event_id FROM events),
    l AS (SELECT session, list([action] ORDER BY ts, event_id) AS actions FROM a GROUP BY session),
    f AS (SELECT session, len(actions) AS n, list_reduce(list_prepend(['idle', 'n'], actions), lambda s, b: [
        CASE WHEN b[1] = 'profile-loaded' THEN CASE WHEN s[1] = 'idle' THEN 'viewing' ELSE s[1] END WHEN b[1] = 'extract-started' THEN 'extracting' WHEN b[1] = 'cleared' THEN 'idle'
            WHEN b[1] IN ('cancelled', 'failed') OR (s[1] = 'extracting' AND b[1] = 'review-empty') THEN CASE WHEN s[2] = 'y' THEN 'viewing' ELSE 'idle' END WHEN s[1] = 'extracting' AND b[1] = 'review-ready' THEN 'reviewing'
            WHEN s[1] = 'reviewing' AND b[1] = 'commit-started' THEN 'committing' WHEN s[1] = 'committing' AND b[1] = 'commit-succeeded' THEN 'viewing' ELSE s[1] END,
        CASE WHEN b[1] = 'profile-loaded' OR (s[1] = 'committing' AND b[1] = 'commit-succeeded') THEN 'y' WHEN b[1] = 'cleared' THEN 'n' ELSE s[2] END]) AS s FROM l)
    SELECT session, s[1] AS phase, s[2] = 'y' AS held, CAST(n AS BIGINT) AS n_actions FROM f""")
def state_machine_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state each user's actions end in; the events table gives the actions."""
    from ..streaming.phases import fold

    pick = F.pmod(F.col("event_id") * 7 + F.floor("value").cast("long"), F.lit(16)).cast("int")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("place"), F.get(F.array(*map(F.lit, _ACTION_NAMES)), pick).alias("action"))
    return fold(e)


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey AS b FROM nation WHERE n_nationkey <> n_regionkey UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey % 4 <> 1),
    reach(m) AS (SELECT CAST(2 AS BIGINT) UNION SELECT CAST(b AS BIGINT) FROM e JOIN reach ON a = m) SELECT m AS module FROM reach""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that node 2 reaches, cycles included, however long the chains: rounds until nothing is new."""
    from ..operators.match import closure

    n = table(spark, sf_dir, "nation")
    edges = n.where("n_nationkey <> n_regionkey").select(F.col("n_regionkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    edges = edges.unionByName(n.where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("b")))
    return closure(edges.distinct(), spark.range(2, 3).toDF("node")).select(F.col("node").alias("module"))
