"""Review sessions over the star schema: each order is a draft, its line items are the draft's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, scorer, session
from ..sources.labview import DRAFTS_SQL, draft_rows, reports, table
from .registry import ORACLE_SQL, query

_CONFLICTS_SQL = DRAFTS_SQL + """, conflicts AS (
        SELECT report_id AS draft_id, marker_key, 'draft:' || report_id || ':conflict:' || marker_key AS conflict_id, list(row_no ORDER BY row_no) AS candidates
        FROM draft_rows GROUP BY ALL HAVING count(*) > 1
    )"""
#: Two fifths of the conflicts are answered with the last row, two fifths edited, the rest open.
_ANSWERED_SQL = _CONFLICTS_SQL + """, answered AS (
        SELECT *, CASE WHEN draft_id % 5 < 2 THEN 'choose' WHEN draft_id % 5 < 4 THEN 'edited' END AS kind, CASE WHEN draft_id % 5 < 2 THEN candidates[len(candidates)] END AS row FROM conflicts
    )"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_rows(spark, sf_dir).withColumn("draft_id", F.col("report_id"))


def _answered(rows: DataFrame) -> DataFrame:
    k = F.col("draft_id") % 5
    kind, row = F.when(k < 2, "choose").when(k < 4, "edited"), F.when(k < 2, F.element_at("candidates", -1))
    return session.conflicts(rows).withColumn("resolution", F.when(k < 4, F.struct(kind.alias("kind"), row.alias("row_no"))))


@query(f"WITH {_CONFLICTS_SQL} SELECT draft_id, marker_key, conflict_id, array_to_string(candidates, ',') AS candidates FROM conflicts")
def draft_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = session.conflicts(_rows(spark, sf_dir))
    return c.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query(f"""WITH {_ANSWERED_SQL}, kept AS (SELECT * FROM draft_rows WHERE NOT (report_id % 5 = 0 AND row_no = 1)),
    now AS (SELECT report_id AS draft_id, marker_key, list(row_no ORDER BY row_no) AS candidates FROM kept GROUP BY ALL HAVING count(*) > 1)
    SELECT n.draft_id, n.marker_key, coalesce(a.conflict_id, 'draft:' || n.draft_id || ':conflict:' || n.marker_key) AS conflict_id, CASE WHEN a.candidates = n.candidates THEN a.kind END AS kind,
        CASE WHEN a.candidates = n.candidates THEN a.row END AS chosen FROM now n LEFT JOIN answered a ON a.draft_id = n.draft_id AND a.marker_key = n.marker_key""")
def conflict_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts rebuilt after a row was deleted from a fifth of the drafts: answers live on where the candidates do."""
    rows = _rows(spark, sf_dir)
    kept = rows.where(~((F.col("draft_id") % 5 == 0) & (F.col("row_no") == 1)))
    out = session.carry_over(_answered(rows), session.conflicts(kept))
    return out.select("draft_id", "marker_key", "conflict_id", F.col("resolution.kind").alias("kind"), F.col("resolution.row_no").alias("chosen"))


@query(f"""WITH {_ANSWERED_SQL} SELECT conflict_id, CASE WHEN draft_id % 2 = 0 AND list_contains(candidates, 2) THEN 'choose' ELSE kind END AS kind, CASE WHEN draft_id % 2 = 0 AND list_contains(candidates, 2) THEN 2 ELSE row END AS chosen
    FROM answered""")
def resolve_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the drafts choose row 2 for every conflict; where that is no candidate the earlier answer stays."""
    answered = _answered(_rows(spark, sf_dir))
    answers = answered.where(F.col("draft_id") % 2 == 0).select("conflict_id", F.lit("choose").alias("kind"), F.lit(2).cast("long").alias("row_no"))
    out = session.resolve(answered, answers)
    return out.select("conflict_id", F.col("resolution.kind").alias("kind"), F.col("resolution.row_no").alias("chosen"))


@query(f"""WITH {_ANSWERED_SQL}, j AS (SELECT r.*, a.kind, a.row, a.candidates[1] AS first FROM draft_rows r LEFT JOIN answered a ON a.draft_id = r.report_id AND a.marker_key = r.marker_key)
    SELECT report_id AS draft_id, row_no, marker_key, coalesce(first, row_no) AS place, CASE WHEN kind = 'edited' THEN 1.5 ELSE value END AS value FROM j
    WHERE first IS NULL OR (kind = 'choose' AND row_no = row) OR (kind = 'edited' AND row_no = first)""")
def measurements_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a session commits: uncontested, chosen or edited; unresolved keys are dropped."""
    rows = _rows(spark, sf_dir)
    out = session.measurements_of(rows, _answered(rows).withColumn("edited_value", F.lit(1.5)))
    return out.select("draft_id", "row_no", "marker_key", "place", "value")


@query(f"""WITH {DRAFTS_SQL} SELECT report_id AS draft_id, row_no, starts_with(marker_key, 'x:') AND (row_no = 2 OR report_id % 4 = 0) AS approved FROM draft_rows""")
def approve_unknown_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 2 and all rows of a quarter of the drafts are named for approval; only unknown markers take it."""
    rows = _rows(spark, sf_dir).withColumn("approved", F.lit(False))
    return session.approve(rows, (F.col("row_no") == 2) | (F.col("draft_id") % 4 == 0)).select("draft_id", "row_no", "approved")


@query(f"""WITH {DRAFTS_SQL}, e AS (SELECT report_id AS draft_id, row_no, marker_key AS old, CASE row_no WHEN 1 THEN 'x:renamed' WHEN 2 THEN 'm3' ELSE marker_key END AS marker_key, 'part ' || l_partkey AS label FROM draft_rows)
    SELECT draft_id, row_no, marker_key, CASE WHEN row_no = 1 THEN 'a new name' ELSE label END AS label, CASE row_no WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE starts_with(old, 'x:') END AS approved FROM e""")
def reassign_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row becomes an unknown marker under a new label, the second a known one: approval follows the key."""
    rows = _rows(spark, sf_dir).withColumn("label", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).withColumn("approved", session.is_unknown(F.col("marker_key")))
    n = F.col("row_no")
    out = session.reassign(rows, n <= 2, F.when(n == 1, "x:renamed").otherwise("m3"), F.lit("a new name"))
    return out.select("draft_id", "row_no", "marker_key", "label", "approved")


@query(f"""WITH {DRAFTS_SQL}, e AS (SELECT report_id AS draft_id, row_no, CASE WHEN row_no = 1 THEN CASE report_id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'categorical' ELSE 'missing' END ELSE status END AS status, row_no = 1 AS hit,
        CASE WHEN row_no = 1 THEN 7.25 ELSE value END AS value, comparator, unit, range_kind, CASE WHEN row_no = 1 THEN 'negative' END AS text_value FROM draft_rows)
    SELECT draft_id, row_no, status, CASE WHEN NOT hit OR status = 'value' THEN value END AS value, CASE WHEN NOT hit OR status = 'value' THEN comparator END AS comparator, CASE WHEN NOT hit OR status <> 'categorical' THEN unit END AS unit,
        CASE WHEN NOT hit OR status <> 'categorical' THEN range_kind END AS range_kind, CASE WHEN NOT hit OR status = 'categorical' THEN text_value END AS text_value FROM e""")
def edit_row_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each draft gets a new status and value; fields its status cannot carry go, other rows stay."""
    rows = _rows(spark, sf_dir).withColumn("text_value", F.lit(None).cast("string"))
    k = F.col("draft_id") % 3
    new = {"status": F.when(k == 0, "value").when(k == 1, "categorical").otherwise("missing"), "value": F.lit(7.25), "text_value": F.lit("negative")}
    return session.edit_measurements(rows, F.col("row_no") == 1, new).select("draft_id", "row_no", "status", "value", "comparator", "unit", "range_kind", "text_value")


@query(f"""WITH {DRAFTS_SQL}, r AS (SELECT report_id AS draft_id, row_no, marker_key, 'part ' || l_partkey || '  of ' || l_suppkey AS label FROM draft_rows),
    f AS (SELECT DISTINCT draft_id, 'of' AS text FROM r WHERE draft_id % 4 = 1)
    SELECT r.draft_id, row_no, CASE WHEN f.text IS NULL THEN label ELSE trim(regexp_replace(replace(label, 'of', ''), '\\s+', ' ', 'g')) END AS label,
        count(*) OVER (PARTITION BY r.draft_id, marker_key) > 1 AS contested, FALSE AS date_confirmed FROM r LEFT JOIN f ON f.draft_id = r.draft_id""")
def begin_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session as it opens: dates unconfirmed, identifiers in known positions gone from the rows, conflicts built."""
    rows = _rows(spark, sf_dir).withColumn("label", F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("  of "), F.col("l_suppkey").cast("string")))
    results = reports(spark, sf_dir).select(F.col("report_id").alias("draft_id"), "collected_date")
    found = results.select("draft_id", F.when(F.col("draft_id") % 4 == 1, "of").otherwise("part").alias("text"), (F.col("draft_id") % 4 == 1).alias("known_position"))
    drafts, clean, conflicts = session.begin(results, rows, found)
    contested = conflicts.select("draft_id", "marker_key", F.lit(True).alias("contested"))
    out = clean.join(contested, ["draft_id", "marker_key"], "left").join(drafts.select("draft_id", "date_confirmed"), "draft_id")
    return out.select("draft_id", "row_no", "label", F.coalesce("contested", F.lit(False)).alias("contested"), "date_confirmed")


_DRAFTS_OF = """drafts AS (
        SELECT o_custkey AS profile_id, o_orderkey AS draft_id, CAST(o_orderdate AS DATE) AS collected_date, CASE WHEN o_orderkey % 4 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' END AS time,
            o_orderkey % 10 <> 9 AS date_confirmed, CASE WHEN o_orderkey % 60 = 6 THEN o_orderkey + 1 WHEN o_orderkey % 12 = 0 THEN first END AS target_id
        FROM orders LEFT JOIN (SELECT o_custkey AS owner, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) ON owner = o_custkey WHERE o_orderkey % 3 = 0
    ), stored AS (
        SELECT o_custkey AS profile_id, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS collected_date, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' END AS time FROM orders WHERE o_orderkey % 3 <> 0
    )"""


def _session_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = reports(spark, sf_dir)
    n = F.col("report_id")
    first = r.where(n % 3 != 0).groupBy("profile_id").agg(F.min("report_id").alias("first"))
    at = lambda past: F.concat(F.lpad((n % 24).cast("string"), 2, "0"), F.lit(past))
    drafts = r.where(n % 3 == 0).join(first, "profile_id", "left").select("profile_id", n.alias("draft_id"), "collected_date", F.when(n % 4 != 0, at(":00")).alias("time"), (n % 10 != 9).alias("date_confirmed"), F.when(n % 60 == 6, n + 1).when(n % 12 == 0, F.col("first")).alias("target_id"))
    return drafts, r.where(n % 3 != 0).select("profile_id", "report_id", "collected_date", F.when(n % 5 != 0, at(":30")).alias("time"))


@query(f"""WITH {_ANSWERED_SQL}, {_DRAFTS_OF}, s AS (SELECT c_custkey AS profile_id, c_custkey % 7 <> 0 AS same_person FROM customer),
    staged AS (SELECT profile_id, report_id, CASE WHEN profile_id % 13 <> 0 THEN collected_date + 1 END AS new_date, time AS new_time FROM stored WHERE report_id % 11 = 0),
    moments AS (SELECT t.profile_id, CASE WHEN g.report_id IS NOT NULL THEN g.new_date ELSE t.collected_date END AS d, t.time FROM stored t LEFT JOIN staged g USING (report_id) UNION ALL SELECT profile_id, collected_date, time FROM drafts WHERE target_id IS NULL),
    g AS (SELECT profile_id,
        NOT EXISTS (SELECT 1 FROM drafts d WHERE d.profile_id = s.profile_id AND NOT date_confirmed) AS dates_confirmed,
        NOT EXISTS (SELECT 1 FROM drafts d JOIN answered a ON a.draft_id = d.draft_id WHERE d.profile_id = s.profile_id AND kind IS NULL) AS conflicts_resolved,
        NOT EXISTS (SELECT 1 FROM drafts d WHERE d.profile_id = s.profile_id AND d.draft_id % 7 = 3 AND s.profile_id % 5 = 0) AS identifiers_resolved,
        NOT EXISTS (SELECT 1 FROM drafts d JOIN draft_rows r ON r.report_id = d.draft_id WHERE d.profile_id = s.profile_id AND starts_with(marker_key, 'x:') AND row_no = 4) AS unknowns_approved,
        NOT EXISTS (SELECT 1 FROM drafts d WHERE d.profile_id = s.profile_id AND target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored t WHERE t.profile_id = s.profile_id AND t.report_id = d.target_id)) AS targets_exist,
        NOT EXISTS (SELECT 1 FROM drafts d JOIN stored t ON t.profile_id = d.profile_id AND t.report_id = d.target_id JOIN draft_rows r ON r.report_id = d.draft_id JOIN draft_rows h ON h.report_id = t.report_id AND h.marker_key = r.marker_key
            WHERE d.profile_id = s.profile_id) AS targets_free,
        same_person OR NOT EXISTS (SELECT 1 FROM stored t WHERE t.profile_id = s.profile_id) AS same_person,
        NOT EXISTS (SELECT 1 FROM staged x WHERE x.profile_id = s.profile_id AND new_date IS NULL) AS staged_dates_valid,
        NOT EXISTS (SELECT 1 FROM (SELECT m.d FROM moments m WHERE m.profile_id = s.profile_id GROUP BY m.d HAVING count(*) > 1 AND (count(m.time) < count(*) OR count(DISTINCT m.time) < count(*)))) AS days_distinct,
        EXISTS (SELECT 1 FROM drafts d WHERE d.profile_id = s.profile_id) AS any_draft FROM s)
    SELECT profile_id, dates_confirmed, conflicts_resolved, identifiers_resolved, unknowns_approved, targets_exist, targets_free, same_person, staged_dates_valid, days_distinct,
        any_draft AND dates_confirmed AND conflicts_resolved AND identifiers_resolved AND unknowns_approved AND targets_exist AND targets_free AND same_person AND staged_dates_valid AND days_distinct AS may_confirm FROM g""")
def confirm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine gates of each customer's session: a third of the orders are drafts, the rest their stored history."""
    drafts, stored = _session_tables(spark, sf_dir)
    rows = _rows(spark, sf_dir).withColumn("approved", F.col("row_no") != 4)
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") % 7 != 0).alias("same_person"))
    identifiers = drafts.where(F.col("draft_id") % 7 == 3).select("profile_id", F.when(F.col("profile_id") % 5 != 0, "redacted").alias("resolution"))
    staged = stored.where(F.col("report_id") % 11 == 0).select("profile_id", "report_id", F.when(F.col("profile_id") % 13 != 0, F.date_add("collected_date", 1)).alias("new_date"), F.col("time").alias("new_time"))
    held = rows.select("report_id", "marker_key")
    return session.confirm_gates(sessions, drafts, rows, _answered(rows), identifiers, stored, held, staged)


_ID = "substr(sha256('report:' || d.draft_id), 1, 16)"


@query(f"""WITH {_ANSWERED_SQL}, {_DRAFTS_OF}, j AS (SELECT r.*, a.kind, a.row, a.candidates[1] AS first FROM draft_rows r LEFT JOIN answered a ON a.draft_id = r.report_id AND a.marker_key = r.marker_key),
    c AS (SELECT report_id AS draft_id, count(*) AS n FROM j WHERE first IS NULL OR (kind = 'choose' AND row_no = row) OR (kind = 'edited' AND row_no = first) GROUP BY 1),
    p AS (SELECT CASE WHEN target_id IS NULL THEN {_ID} ELSE CAST(target_id AS VARCHAR) END AS report_id, target_id IS NOT NULL AS aimed, n FROM drafts d JOIN c ON c.draft_id = d.draft_id),
    r AS (SELECT {_ID} AS report_id, collected_date, 'addition' AS outcome FROM drafts d WHERE target_id IS NULL UNION ALL
        SELECT CAST(report_id AS VARCHAR), CASE WHEN report_id % 11 = 0 THEN collected_date + 1 ELSE collected_date END, 'update' FROM stored
        WHERE report_id % 11 = 0 OR CAST(report_id AS VARCHAR) IN (SELECT report_id FROM p WHERE aimed))
    SELECT r.report_id, collected_date, outcome, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM p WHERE p.report_id = r.report_id), 0) AS n_added FROM r""")
def build_profile_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What confirming writes: additions under new ids, and stored reports that get measurements or a staged date."""
    drafts, stored = _session_tables(spark, sf_dir)
    rows = _rows(spark, sf_dir)
    committed = session.measurements_of(rows, _answered(rows)).drop("report_id")
    staged = stored.where(F.col("report_id") % 11 == 0).select("report_id", F.date_add("collected_date", 1).alias("new_date"))
    changed, placed = session.build_change(drafts, committed, staged, stored)
    n = placed.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    return changed.join(n, "report_id", "left").select("report_id", "collected_date", "outcome", F.coalesce("n", F.lit(0).cast("long")).alias("n_added"))


@query(f"""WITH {_DRAFTS_OF}, c AS (SELECT profile_id, report_id, collected_date + 7 AS d FROM stored WHERE report_id % 4 = 1 UNION ALL SELECT profile_id, draft_id, collected_date FROM drafts),
    a AS (SELECT c_custkey AS profile_id, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS same FROM customer), ok AS (SELECT profile_id, coalesce(same, FALSE) OR profile_id NOT IN (SELECT profile_id FROM stored) AS ok FROM a)
    SELECT coalesce(s.profile_id, c.profile_id) AS profile_id, coalesce(s.report_id, c.report_id) AS report_id, CASE WHEN ok THEN coalesce(c.d, s.collected_date) ELSE s.collected_date END AS collected_date,
        CASE WHEN NOT ok THEN 'same-person-unconfirmed' END AS refusal
    FROM stored s FULL JOIN c ON s.profile_id = c.profile_id AND s.report_id = c.report_id JOIN ok ON ok.profile_id = coalesce(s.profile_id, c.profile_id) WHERE ok OR s.report_id IS NOT NULL""")
def apply_profile_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored histories after their changes; a history not confirmed to be the same person's stays as it was and says why."""
    drafts, stored = _session_tables(spark, sf_dir)
    changed = stored.where(F.col("report_id") % 4 == 1).select("profile_id", "report_id", F.date_add("collected_date", 7).alias("collected_date"))
    changed = changed.unionByName(drafts.select("profile_id", F.col("draft_id").alias("report_id"), "collected_date"))
    key = F.col("c_custkey") % 3
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.when(key == 0, True).when(key == 1, False).alias("same_person"))
    return session.apply_change(stored, changed, answers)


@query("""
    WITH s AS (SELECT o_custkey AS profile_id, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 24 END AS time, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
    a AS (SELECT o_custkey AS profile_id, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 24 END AS time, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v
        FROM orders WHERE o_orderkey % 2 = 0),
    added AS (SELECT * FROM a WHERE report_id NOT IN (SELECT report_id FROM s)), bad AS (SELECT DISTINCT a.profile_id FROM a JOIN s ON s.report_id = a.report_id WHERE s.v <> a.v),
    day AS (SELECT DISTINCT x.profile_id FROM added x JOIN s ON s.profile_id = x.profile_id AND s.d = x.d WHERE s.time IS NULL OR x.time IS NULL),
    p AS (SELECT DISTINCT profile_id FROM (SELECT profile_id FROM s UNION ALL SELECT profile_id FROM a))
    SELECT p.profile_id, CASE WHEN p.profile_id IN (SELECT profile_id FROM bad) THEN 'report-id-conflict' WHEN p.profile_id IN (SELECT profile_id FROM day) THEN 'same-day-precision-conflict' END AS error,
        (SELECT count(*) FROM s WHERE s.profile_id = p.profile_id) + CASE WHEN p.profile_id IN (SELECT profile_id FROM bad) OR p.profile_id IN (SELECT profile_id FROM day) THEN 0
            ELSE (SELECT count(*) FROM added x WHERE x.profile_id = p.profile_id) END AS n_reports FROM p""")
def apply_profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after a merge: the first kind of conflict refuses it, else the additions are in."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = o.select(F.col("o_custkey").alias("profile_id"), n.alias("report_id"), F.to_date("o_orderdate").alias("collected_date"), F.when(n % 5 != 0, (n % 24).cast("string")).alias("time"), F.col("o_totalprice").alias("v"))
    n = F.col("report_id")
    stored, arriving = base.where(n % 3 != 0), base.where(n % 2 == 0).withColumn("v", F.when(n % 97 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return profile.apply_merge(stored, arriving)


@query(f"""WITH {_ANSWERED_SQL}, r AS (SELECT report_id AS draft_id, row_no, marker_key, CASE WHEN comparator IS NOT NULL THEN 'medium' ELSE 'high' END AS confidence, range_kind IS NULL AS flagged FROM draft_rows)
    SELECT draft_id, row_no, confidence <> 'high' OR flagged OR (starts_with(marker_key, 'x:') AND row_no % 2 = 0)
        OR EXISTS (SELECT 1 FROM answered a WHERE a.draft_id = r.draft_id AND a.marker_key = r.marker_key AND a.kind IS NULL) AS needs_review FROM r""")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a person still has to look at."""
    rows = _rows(spark, sf_dir).withColumn("confidence", F.when(F.col("comparator").isNotNull(), "medium").otherwise("high"))
    rows = rows.withColumn("flags", F.array_compact(F.array(F.when(F.col("range_kind").isNull(), "unparsed-range")))).withColumn("approved", F.col("row_no") % 2 == 1)
    return session.needs_review(rows, _answered(rows)).select("draft_id", "row_no", "needs_review")


@query(f"""WITH {DRAFTS_SQL}, e AS (SELECT * FROM draft_rows), p AS (SELECT * REPLACE (CASE WHEN l_partkey % 17 = 0 THEN unit || 'x' ELSE unit END AS unit, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE range_min END AS range_min) FROM draft_rows WHERE l_suppkey % 5 <> 0 UNION ALL
        SELECT * REPLACE (100 + row_no AS row_no, 'm1' AS marker_key) FROM draft_rows WHERE l_suppkey % 23 = 0),
    ne AS (SELECT *, row_number() OVER (PARTITION BY report_id, marker_key ORDER BY row_no) AS k FROM e WHERE marker_key <> 'm7'),
    na AS (SELECT *, row_number() OVER (PARTITION BY report_id, marker_key ORDER BY row_no) AS k FROM p WHERE marker_key <> 'm7'),
    j AS (SELECT e.report_id IS NOT NULL AS he, a.report_id IS NOT NULL AS ha, coalesce(e.report_id, a.report_id) % 10 AS lab, e.unit AS eu, a.unit AS au, e.range_min AS er, a.range_min AS ar, e.value AS ev, a.value AS av
        FROM ne e FULL JOIN na a ON e.report_id = a.report_id AND e.marker_key = a.marker_key AND e.k = a.k)
    SELECT lab, count(*) FILTER (WHERE he AND ha) AS matched, count(*) FILTER (WHERE he) AS expected, count(*) FILTER (WHERE ha) AS judged, count(*) FILTER (WHERE he AND ha AND ev IS NOT DISTINCT FROM av) AS values_correct,
        count(*) FILTER (WHERE ha AND CASE WHEN he THEN eu IS NOT NULL OR au IS NOT NULL ELSE au IS NOT NULL END) AS unit_total, count(*) FILTER (WHERE he AND ha AND eu = au) AS unit_correct,
        count(*) FILTER (WHERE ha AND CASE WHEN he THEN er IS NOT NULL OR ar IS NOT NULL ELSE ar IS NOT NULL END) AS range_total, count(*) FILTER (WHERE he AND ha AND er = ar) AS range_correct,
        (SELECT count(*) FROM p WHERE marker_key = 'm7' AND report_id % 10 = j.lab) AS unjudged FROM j GROUP BY lab""")
def score_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each laboratory by opportunity, with markers that were not judged left out and counted."""
    rows = draft_rows(spark, sf_dir).select("report_id", "row_no", "marker_key", "l_partkey", "l_suppkey", "value", "unit", "range_min")
    emitted = rows.where(F.col("l_suppkey") % 5 != 0).withColumn("unit", F.when(F.col("l_partkey") % 17 == 0, F.concat("unit", F.lit("x"))).otherwise(F.col("unit")))
    emitted = emitted.withColumn("range_min", F.when(F.col("l_partkey") % 19 != 0, F.col("range_min")))
    emitted = emitted.unionByName(rows.where(F.col("l_suppkey") % 23 == 0).withColumn("row_no", F.col("row_no") + 100).withColumn("marker_key", F.lit("m1")))
    with_lab = lambda d: d.withColumn("lab", F.col("report_id") % 10)
    judged = spark.range(1).select(F.lit("m7").alias("marker_key"))
    return scorer.score(with_lab(rows), with_lab(emitted), judged, "lab")


@query(f"""WITH {DRAFTS_SQL}, l AS (SELECT report_id, row_no, marker_key, CASE row_no % 6 WHEN 1 THEN 'plain label' WHEN 2 THEN repeat('long ', 30) WHEN 3 THEN 'two' || chr(10) || 'lines' WHEN 4 THEN 'id 01018099901' WHEN 5 THEN 'a.b@c.gr' END AS label FROM draft_rows),
    v AS (SELECT report_id, row_no, unnest(list_filter([CASE WHEN NOT starts_with(marker_key, 'x:') THEN 'label-on-known-key' END, CASE WHEN length(label) > 120 THEN 'label-too-long' END, CASE WHEN regexp_matches(label, '[\\x00-\\x1F\\x7F]') THEN 'label-control-characters' END,
        CASE WHEN regexp_matches(label, '\\b\\d{{11}}\\b') THEN 'label-national-id' END, CASE WHEN regexp_matches(label, '[^\\s@]+@[^\\s@]+\\.[A-Za-z]{{2,}}') THEN 'label-email' END], lambda x: x IS NOT NULL)) AS rule FROM l WHERE label IS NOT NULL)
    SELECT * FROM v""")
def profile_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may not be stored: on known keys, too long, with control characters or looking like an identifier."""
    k = F.col("row_no") % 6
    label = F.when(k == 1, "plain label").when(k == 2, F.repeat(F.lit("long "), 30)).when(k == 3, "two\nlines").when(k == 4, "id 01018099901").when(k == 5, "a.b@c.gr")
    return profile.unsafe_labels(draft_rows(spark, sf_dir).withColumn("label", label)).select("report_id", "row_no", "rule")


@query(f"""WITH {DRAFTS_SQL}, d AS (SELECT report_id, row_no, CASE WHEN row_no = 3 THEN '' ELSE marker_key END AS marker_key, CASE WHEN row_no = 5 THEN 'odd' WHEN row_no = 2 AND report_id % 3 = 0 THEN 'missing' ELSE status END AS status, value, comparator, range_kind, range_min, range_max
        FROM draft_rows),
    v AS (SELECT report_id, row_no, CASE WHEN marker_key = '' THEN 'no-marker-key' WHEN status NOT IN ('value', 'categorical', 'missing') THEN 'unknown-status' WHEN status = 'value' AND value IS NULL THEN 'value-missing'
            WHEN status = 'missing' AND (value IS NOT NULL OR comparator IS NOT NULL) THEN 'missing-with-value' WHEN range_kind = 'closed' AND range_min > range_max THEN 'range-order' END AS fault FROM d)
    SELECT report_id, arg_min(fault, row_no) AS fault, min(row_no) AS first_row, count(*) AS n_faults FROM v WHERE fault IS NOT NULL GROUP BY report_id""")
def scorable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that cannot be scored: the first row that breaks a rule, and how many do."""
    n = F.col("row_no")
    status = F.when(n == 5, "odd").when((n == 2) & (F.col("report_id") % 3 == 0), "missing").otherwise(F.col("status"))
    rows = draft_rows(spark, sf_dir).withColumn("marker_key", F.when(n == 3, "").otherwise(F.col("marker_key"))).withColumn("status", status)
    return scorer.unscorable(rows, "report_id", "row_no")


@query(f"""WITH {DRAFTS_SQL}, b AS (SELECT report_id, count(*) FILTER (WHERE status = 'value' AND (value IS NULL OR value > 49)) AS broken, arg_min('measurements[' || row_no || '].value', row_no) FILTER (WHERE status = 'value' AND (value IS NULL OR value > 49)) AS path
        FROM draft_rows GROUP BY report_id)
    SELECT report_id, broken = 0 AS written, CASE WHEN broken > 0 THEN 'reports[' || report_id || '].' || path END AS path FROM b""")
def all_or_nothing_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written only if all their measurements keep the rules; else the path of the first that does not."""
    broken = (F.col("status") == "value") & (F.col("value").isNull() | (F.col("value") > 49))
    return profile.validated(draft_rows(spark, sf_dir), broken, "value")


@query("""
    WITH r AS (SELECT conv_id AS source_id, conv_id % 4 <> 0 AS evidence_available, conv_id % 7 <> 0 AS held, max(turn) AS pages FROM conversations GROUP BY ALL),
    q AS (SELECT event_id, event_id % 400 AS source_id, CAST(event_id % 9 AS INTEGER) AS page FROM events)
    SELECT event_id, CASE WHEN r.source_id IS NULL THEN 'unknown-source' WHEN NOT evidence_available THEN 'unavailable' WHEN NOT held THEN 'unknown-source' WHEN q.page < 1 OR q.page > pages THEN 'unknown-page' ELSE 'evidence' END AS outcome
    FROM q LEFT JOIN r ON r.source_id = q.source_id""")
def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be shown of a printed place: the source, its evidence and the page are checked in that order."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("source_id")).agg(F.max("turn").alias("pages"))
    sources = c.select("source_id", (F.col("source_id") % 4 != 0).alias("evidence_available"), (F.col("source_id") % 7 != 0).alias("held"), "pages")
    refs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 400).alias("source_id"), (F.col("event_id") % 9).cast("int").alias("page"))
    return profile.evidence(refs, sources).select("event_id", "outcome")


#: The least percentages of each metric, over all laboratories and for each one; null: no floor.
_FLOORS = "(0, 'recall', 95), (0, 'value', 99), (0, 'unit', 95), (0, 'range', 95), (1, 'recall', 90), (1, 'value', 98)"


@query(f"""
    WITH s AS ({ORACLE_SQL['score_opportunities']}), f(one, metric, floor_pct) AS (VALUES {_FLOORS}),
    m AS (SELECT CAST(lab AS VARCHAR) AS scope, 1 AS one, unnest([{{'metric': 'recall', 'c': matched, 't': expected}}, {{'metric': 'value', 'c': values_correct, 't': judged}}, {{'metric': 'unit', 'c': unit_correct, 't': unit_total}}, {{'metric': 'range', 'c': range_correct, 't': range_total}}]) AS x FROM s),
    t AS (SELECT scope, one, x.metric AS metric, x.c AS c, x.t AS t FROM m UNION ALL SELECT 'all', 0, x.metric, sum(x.c), sum(x.t) FROM m GROUP BY x.metric)
    SELECT scope, metric, floor_pct, CAST(c AS BIGINT) AS correct, CAST(t AS BIGINT) AS total FROM t JOIN f USING (one, metric) WHERE t > 0 AND c * 100 < floor_pct * t""")
def release_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics below their floor, for each laboratory and for all; what was never asked passes."""
    floors = spark.sql(f"SELECT * FROM VALUES {_FLOORS} AS t(one, metric, floor_pct)")
    return scorer.release_breaches(score_opportunities(spark, sf_dir), "lab", floors)
