"""Printed layouts: rows and lines, neighbourhoods, outward read-out, sections and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extract, identifiers, layout, outward
from ..operators.match import greedy
from ..sources.labview import table
from ..sources.text_items import printed_panels
from .registry import query

_ITEMS = """k AS (SELECT s_suppkey, round(abs(s_acctbal), 2) AS v, r, panel FROM supplier, range(10) a(r), range(2) b(panel)),
    c AS (SELECT *, panel * 0.5 + 0.02 AS lft, r % 4 = 3 AS below, CASE WHEN r % 4 = 3 THEN 0.0 WHEN r % 5 = 4 THEN 0.33 ELSE 0.1 END AS shift, replace(CAST(round(v % (7 + r) + r + panel, 1) AS VARCHAR), '.', ',') AS value FROM k),
    u AS (SELECT *, 0 AS n, 'label' AS role, 'Marker ' || chr(CAST(65 + r + 10 * panel AS INTEGER)) AS text, 0.0 AS dx, 0.08 AS w FROM c UNION ALL SELECT *, 1, 'value', value, shift, 0.03 FROM c
        UNION ALL SELECT *, 2, 'unit', CASE WHEN r % 3 = 0 THEN 'mg/dL' ELSE '%' END, shift + 0.04, 0.03 FROM c UNION ALL SELECT *, 3, 'range', (r + 1) || ' - ' || (r + 12), shift + 0.08, 0.04 FROM c),
    items AS (SELECT 's' || s_suppkey AS source_id, 1 AS page, 2 * r + CASE WHEN below AND role <> 'label' THEN 1 ELSE 0 END AS row_no, r * 8 + panel * 4 + n AS item, role, panel, text, CAST(round(lft + dx, 4) AS DOUBLE) AS x,
        CAST(round(0.1 + r * 0.04 + CASE WHEN below AND role <> 'label' THEN 0.016 ELSE 0 END, 4) AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, 0.0141::DOUBLE AS h, v, r FROM u)"""
_NEAR = _ITEMS + """, a AS (SELECT i.*, coalesce((SELECT min(o.x) FROM items o WHERE o.source_id = i.source_id AND o.row_no = i.row_no AND o.role = 'label' AND o.x > i.x), 1e9) AS bx,
        coalesce((SELECT min(o.y) FROM items o WHERE o.source_id = i.source_id AND o.role = 'label' AND o.y > i.y + i.h), 1e9) AS bry FROM items i WHERE role = 'label'),
    n AS (SELECT a.source_id, a.page, a.item AS anchor, b.item, b.text, b.x AS bx_, b.y AS by_, a.bx, a.x + a.w AS edge,
        CASE WHEN a.row_no = b.row_no AND abs(a.y + a.h / 2 - b.y - b.h / 2) < 0.6 * least(a.h, b.h) THEN CASE WHEN b.x >= a.x + a.w THEN 1 WHEN b.x < a.x THEN 3 END
            WHEN a.row_no <> b.row_no AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 0.5 * least(a.w, b.w) AND b.y - a.y - a.h BETWEEN 0 AND 2.5 * a.h AND b.y < a.bry THEN 2 END AS region
        FROM a JOIN items b ON a.source_id = b.source_id AND a.page = b.page AND a.item <> b.item),
    g AS (SELECT *, min(CASE WHEN region = 1 THEN bx_ END) OVER w AS first, bool_or(region = 1 AND bx_ >= bx) OVER w AS blocked FROM n WHERE region IS NOT NULL WINDOW w AS (PARTITION BY source_id, page, anchor)),
    near AS (SELECT *, coalesce(first - edge > 0.25, FALSE) AS gap, blocked OR coalesce(first - edge > 0.25, FALSE) AS stopped FROM g WHERE region <> 1 OR (bx_ < bx AND NOT coalesce(first - edge > 0.25, FALSE)))"""


def _anchors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = printed_panels(spark, sf_dir)
    labels = items.where("role = 'label'").withColumn("anchor", F.col("item"))
    return outward.barriers(labels), items


@query(f"WITH {_ITEMS} SELECT i.source_id, i.item AS anchor, (SELECT min(o.x) FROM items o WHERE o.source_id = i.source_id AND o.row_no = i.row_no AND o.role = 'label' AND o.x > i.x) AS barrier_x,"
       " (SELECT min(o.y) FROM items o WHERE o.source_id = i.source_id AND o.role = 'label' AND o.y > i.y + i.h) AS barrier_y FROM items i WHERE role = 'label'")
def anchor_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an anchor's reading ends: the next anchor on its row, and the next one below."""
    a, _ = _anchors(spark, sf_dir)
    finite = lambda c: F.when(F.col(c) < outward.FAR, F.col(c)).alias(c)
    return a.select("source_id", "anchor", finite("barrier_x"), finite("barrier_y"))


@query(f"WITH {_NEAR} SELECT source_id, anchor, region, item, text, stopped, CAST(row_number() OVER (PARTITION BY source_id, page, anchor ORDER BY region, CASE region WHEN 1 THEN bx_ WHEN 2 THEN by_ ELSE -bx_ END, CASE region WHEN 2 THEN bx_ ELSE 0 END) AS INTEGER) AS ord FROM near")
def spatial_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each anchor may read, region by region, up to its barriers."""
    return outward.spread(outward.neighbourhood(*_anchors(spark, sf_dir))).select("source_id", "anchor", "region", "item", "text", "stopped", "ord")


@query(f"""WITH {_NEAR}, t AS (SELECT DISTINCT a.source_id, a.item AS anchor, a.r, a.panel, a.v, coalesce(n.stopped, FALSE) AS stopped, round(a.v % (7 + a.r) + a.r + a.panel, 1) AS value, a.r % 4 <> 3 AND a.r % 5 = 4 AS wide
        FROM a JOIN (SELECT source_id, anchor, bool_or(stopped) AS stopped FROM near GROUP BY ALL) n ON n.source_id = a.source_id AND n.anchor = a.item),
    j AS (SELECT t.*, (SELECT count(*) FROM near n WHERE n.source_id = t.source_id AND n.anchor = t.anchor AND contains(n.text, ' - ')) > 0 AS has_range,
        (SELECT string_agg(n.text, ' ' ORDER BY n.region, n.bx_) FROM near n WHERE n.source_id = t.source_id AND n.anchor = t.anchor AND n.region = (SELECT min(region) FROM near m WHERE m.source_id = t.source_id AND m.anchor = t.anchor)) AS printed FROM t)
    SELECT source_id, anchor, CAST(replace(nullif(regexp_extract(printed, '^(\\d+,\\d+)', 1), ''), ',', '.') AS DOUBLE) AS value, nullif(regexp_extract(printed, '^\\d+,\\d+ (mg/dL|%)', 1), '') AS unit,
        CAST(nullif(regexp_extract(printed, '(\\d+) - \\d+$', 1), '') AS DOUBLE) AS range_min, CAST(nullif(regexp_extract(printed, '\\d+ - (\\d+)$', 1), '') AS DOUBLE) AS range_max, stopped FROM j""")
def outward_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, unit and range read outward from each anchor, with nothing but the items' places to go by."""
    read = outward.read(outward.neighbourhood(*_anchors(spark, sf_dir)))
    return read.select("source_id", "anchor", "value", F.col("printed_unit").alias("unit"), "range_min", "range_max", "stopped")


@query(f"""WITH {_NEAR}, used AS (SELECT DISTINCT source_id, anchor, item FROM near UNION SELECT source_id, anchor, anchor FROM near)
    SELECT u.source_id, u.anchor, count(*) AS n_items, min(x) AS x, min(y) AS y, round(max(x + w) - min(x), 9) AS w, round(max(y + h) - min(y), 9) AS h FROM used u JOIN items i ON i.source_id = u.source_id AND i.item = u.item GROUP BY ALL""")
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around everything a row was read from."""
    r = outward.source_refs(outward.neighbourhood(*_anchors(spark, sf_dir)))
    return r.select("source_id", "anchor", "n_items", "x", "y", F.round("w", 9).alias("w"), F.round("h", 9).alias("h"))


@query(f"""WITH {_ITEMS} SELECT source_id, CAST(dense_rank() OVER (PARTITION BY source_id ORDER BY row_no) AS INTEGER) AS row_no, item, text FROM items""")
def cluster_rows_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed rows found from the items' places alone, each item a little off its baseline."""
    jitter = F.col("y") + 0.001 * (F.col("item") % 3)
    items = printed_panels(spark, sf_dir).drop("row_no").withColumn("y", jitter)
    return layout.cluster_rows(items.select("source_id", "page", "item", "text", "x", "y", "w", "h")).select("source_id", "row_no", "item", "text")


@query(f"""WITH {_ITEMS}, l AS (SELECT source_id, (row_no // 2) AS k, row_no, item, text, x, y, h FROM items), b AS (SELECT source_id, row_no, min(y) AS y, min(h) AS h FROM l GROUP BY ALL)
    SELECT source_id, CAST(dense_rank() OVER (PARTITION BY source_id ORDER BY row_no) AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY x, item) AS text, CAST(count(*) AS INTEGER) AS n_items,
        array_to_string(list_transform(range(1, count(*) + 1), lambda i: CAST(coalesce(list_sum(list_transform(list(length(text) ORDER BY x, item)[1:i - 1], lambda n: n + 1)), 0) AS BIGINT)), ',') AS starts FROM l GROUP BY source_id, row_no""")
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page with the place in the line where each item's text starts."""
    items = printed_panels(spark, sf_dir).select("source_id", "page", "item", "text", "x", "y", "w", "h")
    out = layout.assemble_lines(items)
    return out.select("source_id", "line_no", "text", "n_items", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(f"""WITH {_ITEMS} SELECT source_id, row_no, count(*) AS n_items, min(x) AS left_x, min(y) AS top_y, round(max(x + w) - min(x), 9) AS width, CASE WHEN count(*) = 1 THEN min(h) ELSE round(max(y + h) - min(y), 9) END AS height FROM items GROUP BY ALL""")
def row_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each printed row."""
    one = F.count(F.lit(1)) == 1
    return printed_panels(spark, sf_dir).groupBy("source_id", "row_no").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("x").alias("left_x"), F.min("y").alias("top_y"), F.round(F.max(F.col("x") + F.col("w")) - F.min("x"), 9).alias("width"),
        F.when(one, F.min("h")).otherwise(F.round(F.max(F.col("y") + F.col("h")) - F.min("y"), 9)).alias("height"))


@query(f"""WITH {_ITEMS}, d AS (SELECT source_id, item, CASE WHEN item % 13 = 0 THEN '' ELSE text END AS text, CASE WHEN item % 17 = 0 THEN x - 0.6 ELSE x END AS x, y, CASE WHEN item % 19 = 0 THEN w + 0.9 ELSE w END AS w, h FROM items)
    SELECT source_id, item, CASE WHEN text = '' THEN 'empty-text' WHEN x < 0 OR y < 0 THEN 'off-page' WHEN x + w > 1 THEN 'too-wide' WHEN y + h > 1 THEN 'too-high' END AS fault FROM d WHERE text = '' OR x < 0 OR y < 0 OR x + w > 1 OR y + h > 1""")
def observation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned items that no page can hold."""
    n = F.col("item")
    i = printed_panels(spark, sf_dir).withColumn("text", F.when(n % 13 == 0, "").otherwise(F.col("text"))).withColumn("x", F.when(n % 17 == 0, F.col("x") - 0.6).otherwise(F.col("x"))).withColumn("w", F.when(n % 19 == 0, F.col("w") + 0.9).otherwise(F.col("w")))
    return layout.out_of_bounds(i).select("source_id", "item", "fault")


_ROWS = """r AS (SELECT conv_id AS source_id, turn AS row_no, turn // 5 + 1 AS page, text, role = 'system' OR (conv_id + turn) % 7 = 0 AS is_header, length(text) % 4 <> 0 AS has_cells, length(text) % 3 = 0 AS anchored FROM conversations),
    h AS (SELECT *, min(CASE WHEN is_header THEN row_no END) OVER (PARTITION BY source_id) AS first, coalesce(lead(is_header) OVER (PARTITION BY source_id ORDER BY row_no), FALSE) AS ahead FROM r),
    s AS (SELECT *, coalesce(row_no > first AND NOT is_header AND (ahead OR NOT has_cells), FALSE) AS is_heading FROM h)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.when(F.length("text") % 4 != 0, 0.4).otherwise(0.1)
    r = c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("row_no"), (F.floor(F.col("turn") / 5) + 1).alias("page"), "text", ((F.col("role") == "system") | ((F.col("conv_id") + F.col("turn")) % 7 == 0)).alias("is_header"),
                 F.array(F.struct(at.alias("x"))).alias("items"), (F.length("text") % 3 == 0).alias("anchored"), F.lit(0.38).alias("x_value"), F.lit(0.76).alias("x_notes"))
    return r.withColumn("header_row", F.min(F.when(F.col("is_header"), F.col("row_no"))).over(Window.partitionBy("source_id")))


@query(f"WITH {_ROWS} SELECT source_id, row_no, is_heading, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section FROM s")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by look-ahead and by empty cells, and the section each row stands in, across pages."""
    return extract.headings(_rows(spark, sf_dir)).select("source_id", "row_no", "is_heading", "section")


@query(f"WITH {_ROWS} SELECT source_id, row_no FROM s WHERE NOT anchored AND NOT is_header AND NOT is_heading AND row_no > first")
def unknown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the first table header that are neither anchored nor header nor heading: one pass instead of three anti joins."""
    r = extract.headings(_rows(spark, sf_dir))
    return r.where(~F.col("anchored") & ~F.col("is_header") & ~F.col("is_heading") & (F.col("row_no") > F.col("header_row"))).select("source_id", "row_no")


@query(r"""
    WITH l AS (SELECT 'c' || conv_id AS source_id, turn // 3 AS page, turn AS line_no, CASE turn % 4 WHEN 0 THEN 'ΑΜΚΑ Ιατρού: ' || lpad(CAST(conv_id * 7 AS VARCHAR), 11, '0') WHEN 1 THEN 'ΟΝΟΜΑ :  ' || role || ' ' WHEN 2 THEN substr(text, 1, 40) || ' mail a' || (turn % 3) || '@lab.gr now' ELSE text END AS text
        FROM conversations),
    k(label, kind) AS (VALUES ('αμκα', 'national-id'), ('αμκα ιατρου', 'national-id'), ('επωνυμο', 'name'), ('ονομα', 'name')),
    f AS (SELECT source_id, page, line_no, 0 AS ord, kind, trim(substr(text, instr(text, ':') + 1)) AS found, TRUE AS known_position FROM l JOIN k ON instr(text, ':') > 1 AND trim(lower(strip_accents(split_part(text, ':', 1)))) = label WHERE trim(substr(text, instr(text, ':') + 1)) <> ''
        UNION ALL SELECT source_id, page, line_no, 1, 'national-id', unnest(regexp_extract_all(text, '\b\d{11}\b')), FALSE FROM l UNION ALL SELECT source_id, page, line_no, 2, 'email', unnest(regexp_extract_all(text, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}')), FALSE FROM l),
    d AS (SELECT *, row_number() OVER (PARTITION BY source_id, kind, found ORDER BY page, line_no, ord) AS k FROM f)
    SELECT source_id, source_id || ':identifier:' || row_number() OVER (PARTITION BY source_id ORDER BY page, line_no, ord) AS candidate_id, kind, found, known_position, page, line_no FROM d WHERE k = 1""")
def identifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and scanned identifiers of printed lines, each text once, numbered in reading order."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    text = (F.when(turn % 4 == 0, F.concat(F.lit("ΑΜΚΑ Ιατρού: "), F.lpad((F.col("conv_id") * 7).cast("string"), 11, "0"))).when(turn % 4 == 1, F.concat(F.lit("ΟΝΟΜΑ :  "), "role", F.lit(" ")))
            .when(turn % 4 == 2, F.concat(F.substring("text", 1, 40), F.lit(" mail a"), (turn % 3).cast("string"), F.lit("@lab.gr now"))).otherwise(F.col("text")))
    lines = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_id"), F.floor(turn / 3).alias("page"), turn.alias("line_no"), text.alias("text"))
    return identifiers.candidates(lines)


@query("""
    WITH RECURSIVE s AS (SELECT l_orderkey AS row_id, l_linenumber AS start, l_linenumber + 1 + CAST(l_quantity AS INTEGER) % 4 AS stop, 'm' || (l_partkey % 6) AS marker FROM lineitem),
    d AS (SELECT DISTINCT * FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY start - stop, start, stop, marker) AS k FROM d),
    f AS (SELECT row_id, 0 AS k, CAST([] AS STRUCT(start INTEGER, stop INTEGER, marker VARCHAR)[]) AS kept FROM o WHERE k = 1
        UNION ALL SELECT f.row_id, f.k + 1, CASE WHEN len(list_filter(f.kept, lambda x: (x.start < o.stop AND o.start < x.stop) OR x.marker = o.marker)) > 0 THEN f.kept ELSE list_append(f.kept, {'start': CAST(o.start AS INTEGER), 'stop': CAST(o.stop AS INTEGER), 'marker': o.marker}) END
        FROM f JOIN o ON o.row_id = f.row_id AND o.k = f.k + 1),
    l AS (SELECT row_id, arg_max(kept, k) AS kept FROM f GROUP BY row_id)
    SELECT row_id, x.start AS start, x.stop AS stop, x.marker AS marker FROM (SELECT row_id, unnest(kept) AS x FROM l)""")
def greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest spans first, none overlapping a kept one or repeating its marker."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber").cast("int")
    spans = li.select(F.col("l_orderkey").alias("row_id"), start.alias("start"), (start + 1 + F.col("l_quantity").cast("int") % 4).alias("stop"), F.concat(F.lit("m"), (F.col("l_partkey") % 6).cast("string")).alias("marker")).distinct()
    return greedy(spans, "row_id")
