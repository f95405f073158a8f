"""Numbers, ranges, units, cells and display forms as they are printed, made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, display, fuzzy, lexical, numeric, units
from ..operators import extract, intake, readout, session
from ..operators.match import nearest
from ..sources.labview import DRAFTS_SQL, draft_rows, table
from .registry import query

_PRINTED = """printed AS (SELECT DISTINCT l_orderkey AS id, CAST(l_quantity AS INTEGER) AS q, CAST(l_partkey % 40 AS INTEGER) AS p, l_linenumber AS n FROM lineitem)"""


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 40).cast("int").alias("p"), F.col("l_linenumber").alias("n")).distinct()


def _text(*forms: str) -> str:
    """A choice among printed forms, as an expression that both engines read: {q} and {p} stand for numbers; id, n and p choose."""
    cases = []
    for i, form in enumerate(forms):
        parts = [x if x in ("q", "p") else f"'{x}'" for x in form.replace("{q}", "\0q\0").replace("{p}", "\0p\0").split("\0") if x]
        cases.append(f"WHEN {i} THEN concat('', {', '.join(parts) or repr('')})")
    return f"CASE (id * 5 + n * 3 + p) % {len(forms)} {' '.join(cases)} END"


_NUMBER = _text("{q}", "{q},{p}", "<{q}.{p}", "< {q}", "≤{p}", "≥ {p},{q}", "{q}e5", "{q}.123", "0.{q}3", "-{p}", "+{q}.{p}", ">= {p}", "abc{q}", "{q}.{p}.{q}", "")


@query(f"""
    WITH {_PRINTED}, x AS (SELECT DISTINCT {_NUMBER} AS token FROM printed),
    y AS (SELECT token, regexp_extract(token, '^([<>≤≥]?)\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 2) AS s, regexp_extract(token, '^([<>≤≥]?)\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 1) AS c FROM x)
    SELECT token, CASE WHEN s <> '' THEN CAST(replace(s, ',', '.') AS DOUBLE) END AS value, CASE WHEN s <> '' THEN CASE c WHEN '≤' THEN '<=' WHEN '≥' THEN '>=' WHEN '' THEN NULL ELSE c END END AS comparator,
        CASE WHEN s <> '' THEN regexp_matches(s, '^[+-]?[1-9]\\d{{0,2}}[.,]\\d{{3}}$') END AS ambiguous FROM y""")
def parse_number_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _printed(spark, sf_dir).select(F.expr(_NUMBER).alias("token")).distinct().withColumn("p", numeric.parse_number(F.col("token")))
    return p.select("token", "p.value", "p.comparator", "p.ambiguous")


_RANGE = _text("{p} - {q}", "{p},5–{q}.5", "{p}—{q}", "< {q}", "≤{q}.5", ">= {q}", "> {p},2", "Έως {q}", "μέχρι {p}", "{q}", "-{p} - {q}", "<{p} - {q}", "Αρνητικό {q}", "έως{q}")


@query(f"""
    WITH {_PRINTED}, x AS (SELECT DISTINCT {_RANGE} AS text FROM printed), d AS (SELECT text, trim(replace(lower(strip_accents(text)), 'ς', 'σ')) AS t FROM x),
    y AS (SELECT text, regexp_extract(t, '^(?:εωσ|μεχρι)\\s+([+-]?\\d+(?:[.,]\\d+)?)$', 1) AS u, regexp_extract(t, '^([<>≤≥])\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 1) AS c, regexp_extract(t, '^([<>≤≥])\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 2) AS b,
        regexp_extract(t, '^([+-]?\\d+(?:[.,]\\d+)?)\\s*[-–—]\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 1) AS l, regexp_extract(t, '^([+-]?\\d+(?:[.,]\\d+)?)\\s*[-–—]\\s*([+-]?\\d+(?:[.,]\\d+)?)$', 2) AS h FROM d),
    z AS (SELECT text, c, TRY_CAST(replace(u, ',', '.') AS DOUBLE) AS u, TRY_CAST(replace(b, ',', '.') AS DOUBLE) AS b, TRY_CAST(replace(l, ',', '.') AS DOUBLE) AS l, TRY_CAST(replace(h, ',', '.') AS DOUBLE) AS h FROM y)
    SELECT text, CASE WHEN u IS NOT NULL OR (b IS NOT NULL AND c IN ('<', '≤')) THEN 'maxOnly' WHEN b IS NOT NULL THEN 'minOnly' WHEN l <= h THEN 'closed' END AS kind, CASE WHEN b IS NOT NULL AND c IN ('>', '≥') THEN b WHEN l <= h THEN l END AS low,
        CASE WHEN u IS NOT NULL THEN u WHEN b IS NOT NULL AND c IN ('<', '≤') THEN b WHEN l <= h THEN h END AS high, CASE WHEN u IS NOT NULL THEN '<=' WHEN b IS NOT NULL THEN CASE c WHEN '≤' THEN '<=' WHEN '≥' THEN '>=' ELSE c END END AS comparator FROM z""")
def parse_range_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _printed(spark, sf_dir).select(F.expr(_RANGE).alias("text")).distinct().withColumn("p", numeric.parse_range(F.col("text")))
    return p.select("text", "p.kind", F.col("p.min").alias("low"), F.col("p.max").alias("high"), "p.comparator")


_UNIT = _text("mg/dl", "mg / dL", "μmol/l", "k/μl", "Κ/μL", "Μ/μl", "M/µL", "gr/dl", "fl", "x10^3/μL", "x10³/μL", "pg/cell", "%", "k/ml", "u/L", "U{q}/l")
_KNOWN_SQL = ", ".join(f"'{u}'" for u in units.KNOWN)
_PRINTED_UNITS = ", ".join(f"('{a}', '{b}')" for a, b in units.PRINTED.items())


@query(f"""
    WITH {_PRINTED}, x AS (SELECT DISTINCT {_UNIT} AS printed_unit FROM printed), m(a, b) AS (VALUES {_PRINTED_UNITS}),
    f AS (SELECT printed_unit, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(printed_unit, '\\s+', '', 'g'), 'μ', 'µ'), 'Μ/', 'M/', 'g'), '[Κκk]/', 'K/', 'g'), 'l$', 'L') AS u FROM x)
    SELECT printed_unit, coalesce(b, u) AS unit, coalesce(b, u) IN ({_KNOWN_SQL}) AS known FROM f LEFT JOIN m ON a = u""")
def normalise_unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _printed(spark, sf_dir).select(F.expr(_UNIT).alias("printed_unit")).distinct()
    return u.select("printed_unit", units.normalise_unit(F.col("printed_unit")).alias("unit"), units.is_known_unit(F.col("printed_unit")).alias("known"))


_CELL = _text("{q} 1 - 60", "< {q}", "{q} <{p}", "60 - 1 {q}", "{q} 1 - 60 foo", "{q} 1 - 60 k/μl", "Έως {q}", "1-60 {q}", "60 - 1 <{q}", "Ίχνη {q}", "Αρνητικό", "-", "{q} 2-60 60 - 1", "< {q} mg/L < {p}")


@query(f"""
    WITH {_PRINTED}, x AS (SELECT DISTINCT {_CELL} AS text, (id * 5 + n * 3 + p) % 14 AS form FROM printed),
    y AS (SELECT text, regexp_extract(text, '^(\\d+)( |$)', 1) AS lead, regexp_extract(text, '^< (\\d+)', 1) AS less, regexp_extract(text, '(\\d+)$', 1) AS tail, text LIKE '%60 - 1%' AS back, text LIKE '%foo' AS foo FROM x)
    SELECT DISTINCT text, CAST(coalesce(CASE WHEN starts_with(text, '60 - 1') OR starts_with(text, '<') THEN NULL ELSE nullif(lead, '') END, nullif(less, ''), CASE WHEN starts_with(text, '60 - 1 ') AND NOT contains(text, '<') OR starts_with(text, '1-60 ') OR starts_with(text, 'Ίχνη') THEN tail END) AS DOUBLE) AS value,
        CASE WHEN less <> '' THEN '<' END AS comparator,
        CASE WHEN starts_with(text, 'Έως') THEN 'maxOnly' WHEN starts_with(text, '60 - 1') OR foo THEN NULL WHEN text LIKE '%1 - 60%' OR starts_with(text, '1-60') OR text LIKE '%2-60%' THEN 'closed' WHEN regexp_matches(text, '<\\s?\\d+$') AND NOT regexp_matches(text, '^< \\d+$') THEN 'maxOnly' END AS range_kind,
        array_to_string(list_filter([CASE WHEN regexp_matches(text, '^< \\d+$') THEN 'ambiguous-role' END, CASE WHEN starts_with(text, '60 - 1') OR foo THEN 'unparsed-range' END], lambda f: f IS NOT NULL), ',') AS flags,
        CASE WHEN text = 'Αρνητικό' THEN 'categorical' WHEN text = '-' OR starts_with(text, 'Έως') OR (starts_with(text, '60 - 1') AND contains(text, '<')) THEN 'missing' ELSE 'value' END AS status FROM y""")
def read_cells_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, range, flags and status of printed cells: first range wins, parsed or not; tails and units count."""
    c = _printed(spark, sf_dir).select(F.expr(_CELL).alias("text")).distinct()
    words = F.split("text", " ")
    r = c.withColumn("r", readout.read_cells(words, F.transform(words, lambda w: F.lit(True)), F.lit(False)))
    return r.select("text", "r.value", "r.comparator", "r.range_kind", F.array_join("r.flags", ",").alias("flags"), "r.status")


_GLUED = _text("{q}mg/dL", "{q},5%", "{q}", "x{q}", "{p}.{q}µL", "{p}-{q}", "<{q}", "{q}.", "%")


@query(f"""
    WITH {_PRINTED}, x AS (SELECT DISTINCT {_GLUED} AS token FROM printed),
    y AS (SELECT token, regexp_extract(token, '^([+-]?\\d+(?:[.,]\\d+)?)(\\p{{L}}.*|%.*)$', 1) AS a, regexp_extract(token, '^([+-]?\\d+(?:[.,]\\d+)?)(\\p{{L}}.*|%.*)$', 2) AS b FROM x)
    SELECT token, CASE WHEN a <> '' THEN a ELSE token END AS first, nullif(b, '') AS unit, regexp_matches(token, '^[<>≤≥]?[+-]?\\d+([.,]\\d+)?$')
        OR coalesce(TRY_CAST(regexp_extract(token, '^(\\d+)-(\\d+)$', 1) AS INTEGER) <= TRY_CAST(regexp_extract(token, '^(\\d+)-(\\d+)$', 2) AS INTEGER), FALSE) AS numeric FROM y""")
def glued_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with glued units split, and which tokens read as numbers."""
    t = _printed(spark, sf_dir).select(F.expr(_GLUED).alias("token")).distinct()
    s = display.split_glued(F.col("token"))
    return t.select("token", F.get(s, F.lit(0)).alias("first"), F.get(s, F.lit(1)).alias("unit"), display.looks_numeric(F.col("token")).alias("numeric"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'no date' ELSE concat(day(o_orderdate), ' ', CASE WHEN o_orderkey % 2 = 0 THEN monthname(o_orderdate) ELSE ['Ιανουαρίου', 'Φεβρουαρίου', 'Μαρτίου', 'Απριλίου', 'Μαΐου', 'Ιουνίου', 'Ιουλίου', 'Αυγούστου',
    'Σεπτεμβρίου', 'Οκτωβρίου', 'Νοεμβρίου', 'Δεκεμβρίου'][month(o_orderdate)] END, ' ', year(o_orderdate), ' (', strftime(o_orderdate, '%Y-%m-%d'), ')') END AS printed FROM orders""")
def localised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    iso = F.when(n % 9 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", display.localised_date(iso, F.when(n % 2 == 0, "en").otherwise("el")).alias("printed"))


@query("""
    WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-02-30') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') WHEN 2 THEN '9:30' END AS t FROM orders)
    SELECT o_orderkey, CASE WHEN coalesce(t, '') = '' THEN 'day' ELSE 'minute' END AS precision, regexp_matches(d, '^\\d{4}-') AND TRY_CAST(d AS DATE) IS NOT NULL AND (coalesce(t, '') = '' OR regexp_matches(t, '^([01]\\d|2[0-3]):[0-5]\\d$')) AS valid,
        CASE WHEN regexp_matches(d, '^\\d{4}-') AND TRY_CAST(d AS DATE) IS NOT NULL AND coalesce(t, '') = '' THEN epoch_ms(CAST(d AS DATE) + INTERVAL 12 HOUR) END AS noon_ms FROM d""")
def civil_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entered dates and times: their precision, whether they are real, and where a day stands on a time axis."""
    n = F.col("o_orderkey")
    d = F.when(n % 5 == 0, F.date_format("o_orderdate", "yyyy-02-30")).when(n % 5 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    t = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.lpad((n % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 70).cast("string"), 2, "0"))).when(n % 4 == 2, "9:30")
    m = table(spark, sf_dir, "orders").select("o_orderkey", display.collected_at(d, t).alias("c")).select("o_orderkey", "c.*")
    valid = display.valid_moment(F.col("date"), F.col("time"), F.col("precision"))
    noon = F.unix_millis(dates.moment(F.try_to_date("date", "yyyy-MM-dd"), F.col("time")).cast("timestamp"))
    return m.withColumn("valid", valid).select("o_orderkey", "precision", "valid", F.when(F.col("valid") & F.col("time").isNull(), noon).alias("noon_ms"))


@query(f"""WITH {DRAFTS_SQL} SELECT report_id, row_no, CASE WHEN status <> 'value' THEN 'missing' WHEN comparator IS NOT NULL THEN 'censored' ELSE 'value' END AS kind, CASE WHEN starts_with(marker_key, 'x:') THEN 'part ' || l_partkey END AS label FROM draft_rows""")
def measurement_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as stored measurements: the label only under a derived key, and the kind that decides their colour."""
    rows = draft_rows(spark, sf_dir).withColumn("label", F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    return rows.withColumn("kind", display.kind_of(F.col("status"), F.col("comparator"))).select(*display.measurement(["report_id", "row_no", "kind"]))


@query("""
    WITH s AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS correct, count(*) FILTER (WHERE l_linestatus = 'O' AND l_suppkey % 3 <> 0) AS total FROM lineitem GROUP BY 1)
    SELECT l_suppkey, correct, total, CASE WHEN total = 0 THEN '—' ELSE (CAST(round(correct * 1000 / total, 0) AS BIGINT) // 10) || '.' || (CAST(round(correct * 1000 / total, 0) AS BIGINT) % 10) || '%' END AS printed FROM s""")
def percentage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("correct"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 != 0)).alias("total"))
    return g.withColumn("printed", display.percentage(F.col("correct"), F.col("total")))


@query("""
    WITH t AS (SELECT conv_id, list(CASE turn % 4 WHEN 0 THEN 'fr-FR' WHEN 1 THEN 'EN-us' WHEN 2 THEN 'el' ELSE 'de' END ORDER BY turn) AS tags FROM conversations WHERE (conv_id + turn) % 3 = 0 GROUP BY 1)
    SELECT conv_id, coalesce(list_filter(list_transform(tags, lambda x: lower(split_part(x, '-', 1))), lambda x: x IN ('el', 'en'))[1], 'el') AS language FROM t""")
def preferred_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known language among the tags that a browser sends."""
    k = F.col("turn") % 4
    tag = F.when(k == 0, "fr-FR").when(k == 1, "EN-us").when(k == 2, "el").otherwise("de")
    c = table(spark, sf_dir, "conversations").where((F.col("conv_id") + F.col("turn")) % 3 == 0)
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", tag.alias("tag")))), lambda x: x["tag"]).alias("tags"))
    return g.select("conv_id", display.language_of(F.col("tags")).alias("language"))


_ALIASES = "(0, 'red steel'), (1, 'smal ring'), (2, 'large bolt'), (3, 'gren copper'), (4, 'blue'), (5, 'erd bolt'), (6, 'copepr')"


@query(f"""
    WITH a(alias_ord, alias) AS (VALUES {_ALIASES}), n AS (SELECT DISTINCT lower(p_name) AS name, CASE WHEN length(p_name) < 5 THEN 0 WHEN length(p_name) <= 7 THEN 1 ELSE 2 END AS bound FROM part),
    d AS (SELECT name, alias_ord, bound, damerau_levenshtein(name, alias) AS distance FROM n, a), w AS (SELECT *, min(distance) OVER (PARTITION BY name) AS best FROM d WHERE distance <= bound)
    SELECT name, min(alias_ord) AS alias_ord, CAST(best AS INTEGER) AS distance FROM w WHERE distance = best GROUP BY name, best HAVING count(*) = 1""")
def osa_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name with its nearest alias within the bound; ties give none."""
    names = table(spark, sf_dir, "part").select(lexical.normalise_label(F.col("p_name")).alias("name")).distinct()
    aliases = spark.sql(f"SELECT * FROM VALUES {_ALIASES} AS t(alias_ord, alias)")
    near = nearest(names, aliases, "name", "alias")
    best = near.groupBy("name").agg(F.min("distance").alias("best"), F.collect_list(F.struct("distance", "alias_ord")).alias("all"))
    tied = F.filter("all", lambda a: a["distance"] == F.col("best"))
    return best.where(F.size(tied) == 1).select("name", tied[0]["alias_ord"].alias("alias_ord"), F.col("best").alias("distance"))


_VALUE_CELL, _UNIT_CELL, _RANGE_CELL = _text("{q},5", "< {q}", "{q} Όξινη", "Ίχνη", "", "-"), _text("mg / dL", "foo", "", "%", "k/μl x"), _text("1 - 60 k/μl", "60 - 1", "", "<{q}", "1 - 60 foo", "1-60", "Αρνητικό")


@query(f"""
    WITH {_PRINTED}, x AS (SELECT DISTINCT id, n, p, q, {_VALUE_CELL} AS v, {_UNIT_CELL} AS u, {_RANGE_CELL} AS r FROM printed),
    y AS (SELECT *, regexp_extract(v, '^(<?) ?(\\d+(?:,\\d+)?)( |$)', 2) AS num, regexp_extract(v, '^(<?) ?(\\d+(?:,\\d+)?)( |$)', 1) AS cmp, u IN ('mg / dL', '%', 'k/μl x') AS known, CASE WHEN r IN ('1 - 60 k/μl', '1-60') THEN 'closed' WHEN starts_with(r, '<') THEN 'maxOnly' END AS kind FROM x)
    SELECT id || '' AS source_id, n AS row_no, p, q, CASE WHEN num <> '' THEN 'value' WHEN v IN ('', ' ') THEN 'missing' ELSE 'categorical' END AS status, TRY_CAST(replace(num, ',', '.') AS DOUBLE) AS value, nullif(cmp, '') AS comparator,
        CASE WHEN num <> '' OR v = '' THEN CASE u WHEN 'mg / dL' THEN 'mg/dL' WHEN 'k/μl x' THEN '10^3/µL' ELSE nullif(u, '') END END AS unit, CASE WHEN num <> '' OR v = '' THEN kind END AS range_kind FROM y WHERE num <> '' OR known OR kind IS NOT NULL""")
def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unknown markers read by their columns: number, unit run, range with a repeated unit."""
    c = _printed(spark, sf_dir).select(F.col("id").cast("string").alias("source_id"), F.col("n").alias("row_no"), "p", "q", F.lit("A label").alias("c_label"), F.expr(_VALUE_CELL).alias("c_value"), F.expr(_UNIT_CELL).alias("c_unit"), F.expr(_RANGE_CELL).alias("c_range"))
    keyed = c.withColumn("source_id", F.concat_ws("/", "source_id", F.col("p").cast("string"), F.col("q").cast("string")))
    out = extract.positional(keyed)
    part = lambda i: F.substring_index(F.substring_index("source_id", "/", i), "/", -1)
    return out.select(part(1).alias("source_id"), "row_no", part(2).cast("int").alias("p"), part(3).cast("int").alias("q"), "status", "value", "comparator", "unit", "range_kind")


@query("""
    WITH f AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Report.PDF' WHEN 1 THEN 'scan.pdf' ELSE 'scan.pdf.txt' END AS name, CASE WHEN conv_id % 2 = 0 THEN '%PDF-1.7 ' ELSE '%pdf ' END || text AS content FROM conversations)
    SELECT conv_id, turn, lower(name) LIKE '%.pdf' AND starts_with(content, '%PDF-') AS supported FROM f""")
def type_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose name and first bytes both say that they are documents."""
    k = F.col("turn") % 3
    name = F.when(k == 0, "Report.PDF").when(k == 1, "scan.pdf").otherwise("scan.pdf.txt")
    content = F.concat(F.when(F.col("conv_id") % 2 == 0, "%PDF-1.7 ").otherwise("%pdf "), "text").cast("binary")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intake.is_pdf(name, content).alias("supported"))


@query("""
    WITH i AS (SELECT l_orderkey AS page, l_linenumber AS item, l_suppkey AS s, l_quantity * 14.0 AS x, 842.0 - l_quantity * 17 AS b, 30.0 + l_partkey % 70 AS w, 9.0 AS a, -2.5 AS d FROM lineitem), n AS (SELECT *, least(1.0, greatest(0.0, x / 595)) AS nx, least(1.0, greatest(0.0, (842 - b - a) / 842)) AS ny FROM i)
    SELECT page, item, s, round(nx, 9) AS x, round(ny, 9) AS y, round(least(w / 595, 1 - nx), 9) AS w, round(least((a - d) / 842, 1 - ny), 9) AS h FROM n""")
def page_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in points from the bottom left as shares of the page from the top left, clamped to it."""
    q = F.col("l_quantity")
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(F.col("l_linenumber").alias("item"), F.col("l_suppkey").alias("s")).alias("item"), F.lit("").alias("text"), (q * 14.0).alias("x"), (842.0 - q * 17).alias("baseline"),
                                                 (F.lit(30.0) + F.col("l_partkey") % 70).alias("w"), F.lit(9.0).alias("ascent"), F.lit(-2.5).alias("descent"))
    out = intake.normalise_coordinates(i, 595.0, 842.0)
    return out.select("page", "item.item", "item.s", *[F.round(c, 9).alias(c) for c in "xywh"])


@query(f"""
    WITH {DRAFTS_SQL}, r AS (SELECT report_id, row_no, 'part ' || l_partkey AS label, CASE WHEN row_no % 3 = 0 THEN 'seen by A' || l_suppkey END AS text_value, CASE WHEN row_no % 4 = 0 THEN 'A' || (l_suppkey + 1) || ' is usual' END AS reference FROM draft_rows)
    SELECT report_id, row_no FROM r WHERE contains(label, 'A1') OR contains(text_value, 'A1') OR contains(reference, 'A1')""")
def rows_carrying_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label, result or reference holds a text that was called an identifier."""
    r, n = draft_rows(spark, sf_dir), F.col("row_no")
    r = r.withColumn("label", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).withColumn("text_value", F.when(n % 3 == 0, F.concat(F.lit("seen by A"), F.col("l_suppkey").cast("string"))))
    r = r.withColumn("categorical_reference", F.when(n % 4 == 0, F.concat(F.lit("A"), (F.col("l_suppkey") + 1).cast("string"), F.lit(" is usual"))))
    return r.where(session.carries(F.lit("A1"))).select("report_id", "row_no")


_FACTORS = ", ".join(f"({i}, '{m}', '{a}', '{b}', {f})" for i, (m, a, b, f) in enumerate(units.CONVERSIONS))


@query(f"""
    WITH c(i, marker_key, a, b, factor) AS (VALUES {_FACTORS}), v AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity AS value, c.*, CASE l_linenumber % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 'odd' END AS unit FROM lineitem JOIN c ON i = l_partkey % {len(units.CONVERSIONS) + 1})
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, marker_key, unit, CASE unit WHEN a THEN b WHEN b THEN a END AS to_unit, CASE WHEN unit = a THEN value * factor::DOUBLE WHEN unit = b THEN value / factor::DOUBLE END AS converted FROM v""")
def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the other unit of their marker: multiplied one way, divided the other, null where no conversion is listed."""
    li = table(spark, sf_dir, "lineitem")
    kinds = spark.sql(f"SELECT * FROM VALUES {_FACTORS} AS t(i, marker_key, a, b, factor)").drop("factor")
    n = F.col("l_linenumber") % 3
    v = li.join(F.broadcast(kinds), kinds["i"] == li["l_partkey"] % (len(units.CONVERSIONS) + 1)).withColumn("unit", F.when(n == 0, F.col("a")).when(n == 1, F.col("b")).otherwise("odd"))
    c = F.broadcast(units.conversions(spark).withColumnRenamed("from_unit", "unit"))
    out = v.join(c, ["marker_key", "unit"], "left")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "marker_key", "unit", "to_unit", F.when(F.col("to_unit").isNotNull(), units.convert(F.col("l_quantity"), F.col("factor").cast("double"), F.col("forward"))).alias("converted"))
