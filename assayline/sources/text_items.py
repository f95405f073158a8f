"""Positioned text: JSON scans, and printed documents made from the supplier table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import MARKERS
from ..operators.extract import HEADINGS, METADATA, TITLE
from .labview import table

_ITEM = "STRUCT<id: STRING, text: STRING, x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
SCHEMA = f"sourceId STRING, pageCount INT, fragmented STRUCT<pages: ARRAY<ARRAY<{_ITEM}>>>"
EXPECTED = """sourceId STRING, rows ARRAY<STRUCT<markerKey: STRING, label: STRING, status: STRING, value: DOUBLE, comparator: STRING, unit: STRING,
    referenceRange: STRUCT<kind: STRING, min: DOUBLE, max: DOUBLE, comparator: STRING>>>"""


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(items, expected rows) of a corpus of scanned documents, ``root``/<split>/<laboratory>/textitems.json and expected.json.

    Both carry the split and the laboratory that their path names; only Spark opens the files.
    """
    place = lambda k: F.element_at(F.split("_metadata.file_path", "/"), k)
    labelled = lambda name, schema: (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).json(root)
                                     .withColumns({"split": place(-3), "laboratory": place(-2)}))
    items = labelled("textitems.json", SCHEMA).select("split", "laboratory", F.col("sourceId").alias("source_id"), F.posexplode("fragmented.pages").alias("p", "items"))
    items = items.select("split", "laboratory", "source_id", (F.col("p") + 1).alias("page"), F.posexplode("items").alias("o", "i"))
    expected = labelled("expected.json", EXPECTED).select("split", "laboratory", F.col("sourceId").alias("source_id"), F.posexplode("rows").alias("row_no", "r"))
    flat = expected.select("split", "laboratory", "source_id", "row_no", F.col("r.markerKey").alias("marker_key"), "r.label", "r.status", "r.value", "r.comparator", "r.unit", F.col("r.referenceRange.kind").alias("range_kind"),
                           F.col("r.referenceRange.min").alias("range_min"), F.col("r.referenceRange.max").alias("range_max"))
    return items.select("split", "laboratory", "source_id", "page", (F.col("o") + 1).alias("item"), "i.text", "i.x", "i.y", "i.w", "i.h"), flat


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_id, page, item, text, x, y, w, h) of scanned documents, pages and items in their order."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(paths)
    pages = raw.select(F.col("sourceId").alias("source_id"), F.posexplode("fragmented.pages").alias("p", "items"))
    items = pages.select("source_id", (F.col("p") + 1).alias("page"), F.posexplode("items").alias("o", "i"))
    return items.select("source_id", "page", (F.col("o") + 1).alias("item"), "i.text", "i.x", "i.y", "i.w", "i.h")


def _tenths(number: Column) -> Column:
    """A number rounded as SQL's engine rounds it: the tenfold is, so 11.649999999999999, whose tenfold is 116.5, is printed as 11.7."""
    return F.round(number * 10, 0) / 10


_X = {"label": 0.131, "value": 0.3837, "unit": 0.5101, "range": 0.6364, "notes": 0.7628}


def printed_suppliers(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """Every supplier as a two-page document: metadata, then a row for each marker of the registry.

    ``damaged``: by the key's remainder modulo 6 the title (1), a metadata label (2), a column heading (3) or the date (4) is wrong.
    """
    broken = lambda k, good, bad: F.when(F.col("s_suppkey") % 6 == k, bad).otherwise(good) if damaged else F.lit(good)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.abs("s_acctbal"), 2).alias("v"))
    item = lambda page, text, x, y, w=0.1: F.struct(F.lit(page).alias("page"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x).alias("x"), F.lit(float(y)).alias("y"), F.lit(w).alias("w"), F.lit(0.0141).alias("h"))
    parts = [item(1, broken(1, TITLE, "Another document"), 0.283, 0.119, 0.3)]
    for i, m in enumerate(METADATA):
        value = broken(4, "05-03-2024", "31-02-2024") if "Ημερομηνία" in m else F.concat(F.lit("A"), F.col("s_suppkey").cast("string"))
        parts += [item(1, broken(2, f"{m}:", "Other:") if m == "ΑΜΚΑ" else f"{m}:", 0.131, 0.2 + 0.0213 * i), item(1, value, 0.371, 0.2 + 0.0213 * i)]
    parts += [item(2, broken(3, h, "Other") if r == "unit" else h, _X[r], 0.12) for r, h in HEADINGS.items()]
    for i, m in enumerate(MARKERS):
        y, value = 0.15 + 0.0213 * i, F.format_number(F.col("v") % (10 + i) + i, 2)
        parts += [item(2, f"{m.en} ({m.abbreviations[0]})", 0.131, y), item(2, F.replace(F.replace(value, F.lit(","), F.lit("")), F.lit("."), F.lit(",")), _X["value"], y, 0.03), item(2, m.unit, _X["unit"], y, 0.05)]
        parts += [item(2, f"{i} - {2 * i + 10}" if i % 3 else f"<{2 * i + 10}", _X["range"], y)]
    docs = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.posexplode(F.array(*parts)).alias("item", "i"))
    return docs.select("source_id", "i.page", (F.col("item") + 1).alias("item"), "i.text", "i.x", "i.y", "i.w", "i.h")


#: Printed rows that no clean table has: label parts (text, x, below the row's line, width), what the value cell holds ({} stands for a number), unit, range, and the number's base.
LAYOUTS = [
    ([("Haemoglobin (HGB)", 0.131, 0.0, 0.1)], "{}", "g/dL", "12 - 16", 8),
    ([("Haematocrit Platelets", 0.131, 0.0, 0.1)], "{}", "%", "36 - 46", 30),
    ([("RBC", 0.131, 0.0, 0.05), ("WBC", 0.25, 0.0, 0.05)], "{}", "10^3/µL", "4 - 10", 3),
    ([("MCV", 0.131, 0.0, 0.1)], "", "", "80 - 100", 0),
    ([("Mean Corpuscular", 0.131, -0.0065, 0.1), ("Haemoglobin (MCH)", 0.131, 0.0065, 0.1)], "{}", "pg", "27 - 33", 20),
    ([("Strange", 0.131, -0.0065, 0.1), ("thing index", 0.131, 0.0065, 0.1)], "{}", "foo", "1 - 5", 2),
    ([("Serum", 0.131, -0.0065, 0.1), ("Creatinine", 0.131, 0.0065, 0.1)], "{}", "mg/dL", "", 1),
    ([("Red Cell Distribution Width", 0.131, 0.0, 0.2)], "<{}", "%", "11 - 15", 10),
    ([("Monocytez %", 0.131, 0.0, 0.1)], "{}", "%", "2 - 10", 3),
    ([("Βιοχημικές εξετάσεις", 0.131, 0.0, 0.2)], "", "", "", 0),
    ([("Γλυκόζη", 0.131, 0.0, 0.1)], "{}", "mg/dL", "<100", 5000),
    ([("Cholesterol", 0.131, 0.0, 0.1)], "Ίχνη", "", "Αρνητικό", 0),
    ([], "{}", "mg/dL", "", 7),
    ([("PLT 250 10^3/µL 150 - 400", 0.131, 0.0, 0.6)], "", "", "9 - 9", 0),
    ([("Another thing", 0.131, 0.0, 0.1)], "1,234", "mg/dL", "x - y", 0),
]


def printed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a two-page document whose table has the rows of ``LAYOUTS``."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.abs("s_acctbal"), 2).alias("v"))
    item = lambda page, text, x, y, w=0.1: F.struct(F.lit(page).alias("page"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x).alias("x"), F.lit(round(y, 4)).alias("y"), F.lit(w).alias("w"), F.lit(0.0141).alias("h"))
    parts = [item(1, TITLE, 0.283, 0.119, 0.3)]
    for i, m in enumerate(METADATA):
        parts += [item(1, f"{m}:", 0.131, 0.2 + 0.0213 * i), item(1, "05-03-2024" if "Ημερομηνία" in m else F.concat(F.lit("A"), F.col("s_suppkey").cast("string")), 0.371, 0.2 + 0.0213 * i)]
    parts += [item(2, h, _X[r], 0.12) for r, h in HEADINGS.items()]
    for i, (label, value, unit, range_, base) in enumerate(LAYOUTS):
        y, number = 0.17 + 0.05 * i, F.regexp_replace(_tenths(F.col("v") % 5 + base).cast("string"), r"\.", ",")
        parts += [item(2, text, x, y + down, w) for text, x, down, w in label]
        printed = F.concat(F.lit(value.split("{")[0]), number) if "{}" in value else value
        parts += [item(2, text, _X[role], y, 0.05) for role, text in (("value", printed), ("unit", unit), ("range", range_)) if not isinstance(text, str) or text]
    docs = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.posexplode(F.array(*parts)).alias("item", "i"))
    return docs.select("source_id", "i.page", (F.col("item") + 1).alias("item"), "i.text", "i.x", "i.y", "i.w", "i.h")


def printed_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a page of two panels side by side, without table columns: ten rows of label, value, unit and range.

    Every fourth row prints its values below the labels, every fifth leaves a wide gap before them.
    (source_id, page, row_no, item, role, panel, text, x, y, w, h); ``row_no`` is the printed row.
    """
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.abs("s_acctbal"), 2).alias("v"))
    k = s.select("s_suppkey", "v", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r")).withColumn("panel", F.explode(F.array(F.lit(0), F.lit(1))))
    r, panel = F.col("r"), F.col("panel")
    value = F.regexp_replace(_tenths(F.col("v") % (7 + r) + r + panel).cast("string"), r"\.", ",")
    below, wide = r % 4 == 3, r % 5 == 4
    left = panel * 0.5 + 0.02
    shift = F.when(below, 0.0).when(wide, 0.33).otherwise(0.1)
    at = lambda role, text, dx, w: F.struct(F.lit(role).alias("role"), text.alias("text"), F.round(left + dx, 4).alias("x"), F.lit(w).alias("w"))
    cells = F.array(at("label", F.concat(F.lit("Marker "), F.chr(65 + r + 10 * panel)), F.lit(0.0), 0.08), at("value", value, shift, 0.03), at("unit", F.when(r % 3 == 0, "mg/dL").otherwise("%"), shift + 0.04, 0.03),
                    at("range", F.concat((r + 1).cast("string"), F.lit(" - "), (r + 12).cast("string")), shift + 0.08, 0.04))
    i = k.select("s_suppkey", "r", "panel", F.posexplode(cells).alias("n", "c"))
    down = F.when(below & (F.col("c.role") != "label"), 0.016).otherwise(0.0)
    return i.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit(1).alias("page"), (2 * r + F.when(down > 0, 1).otherwise(0)).alias("row_no"), (r * 8 + panel * 4 + F.col("n")).alias("item"), "c.role", "panel",
                    "c.text", "c.x", F.round(0.1 + r * 0.04 + down, 4).alias("y"), "c.w", F.lit(0.0141).alias("h"))
