"""Whole documents: the gate and the parsed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import MARKERS
from ..operators import extract, layout
from ..operators.identifiers import LABELS
from ..sources.text_items import printed_layouts, printed_suppliers
from .registry import query

_ROWS = ", ".join(f"({i}, '{m.key}', '{m.unit}', {m.plausible[0]}, {m.plausible[1]})" for i, m in enumerate(MARKERS))


@query("""
    SELECT 's' || s_suppkey AS source_id, s_suppkey % 6 IN (0, 5) AS ok, CASE s_suppkey % 6 WHEN 1 THEN 'missing-title' WHEN 2 THEN 'missing-metadata' WHEN 3 THEN 'missing-table' WHEN 4 THEN 'missing-date' END AS reject_reason,
        CASE WHEN s_suppkey % 6 <> 4 THEN DATE '2024-03-05' END AS collected_date FROM supplier""")
def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed documents, most of them damaged, with the first check that each fails."""
    rows = extract.with_columns(layout.rows_of(layout.cluster_rows(printed_suppliers(spark, sf_dir, damaged=True))))
    return extract.gate(rows).select("source_id", "ok", "reject_reason", "collected_date")


@query(f"""
    WITH m(i, marker_key, unit, low, high) AS (VALUES {_ROWS}), v AS (SELECT s_suppkey, round(abs(s_acctbal), 2) AS v FROM supplier),
    p AS (SELECT 's' || s_suppkey AS source_id, m.*, round(v % (10 + i) + i, 2) AS value FROM v, m)
    SELECT source_id, i AS source_order, marker_key, value, unit, CASE WHEN i % 3 = 0 THEN 'maxOnly' ELSE 'closed' END AS range_kind, CASE WHEN i % 3 <> 0 THEN CAST(i AS DOUBLE) END AS range_min,
        CAST(2 * i + 10 AS DOUBLE) AS range_max, NOT (value BETWEEN low AND high) AS implausible FROM p""")
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents printed from the supplier table, parsed back to the numbers they were made of."""
    p = extract.parse(printed_suppliers(spark, sf_dir))
    return p.select("source_id", "source_order", "marker_key", "value", "unit", "range_kind", "range_min", "range_max", F.array_contains("flags", "implausible-value").alias("implausible"))


#: What each marker of the printed layouts must come to: place, key, label, tier, base of its number (null: none printed), comparator, text, reference, unit, range, confidence, flags, section.
_LAYOUT_ROWS = """(0, 'haemoglobin', '(HGB)', 'T1', 8, NULL, NULL, NULL, 'g/dL', 'closed', 12, 16, 'high', '', NULL),
    (1, 'hct', 'Haematocrit', 'T2', 30, NULL, NULL, NULL, '%', 'closed', 36, 46, 'medium', 'competing-anchor', NULL), (2, 'plt', 'Platelets', 'T2', 30, NULL, NULL, NULL, '%', 'closed', 36, 46, 'medium', 'competing-anchor', NULL),
    (3, 'rbc', 'RBC', 'T1', NULL, NULL, NULL, NULL, '10^3/µL', NULL, NULL, NULL, 'low', 'competing-anchor', NULL), (4, 'wbc', 'WBC', 'T1', 3, NULL, NULL, NULL, '10^3/µL', 'closed', 4, 10, 'medium', 'competing-anchor', NULL),
    (5, 'mcv', 'MCV', 'T1', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'low', '', NULL), (6, 'mch', '(MCH)', 'T1', 20, NULL, NULL, NULL, 'pg', 'closed', 27, 33, 'high', '', NULL),
    (7, 'x:strange-thing-index', 'Strange thing index', NULL, 2, NULL, NULL, NULL, 'foo', 'closed', 1, 5, 'low', 'unrecognised-unit', NULL), (8, 'creatinine', 'Creatinine', 'T2', 1, NULL, NULL, NULL, 'mg/dL', NULL, NULL, NULL, 'high', '', NULL),
    (9, 'rdw', 'Red Cell Distribution Width', 'T2', 10, '<', NULL, NULL, '%', 'closed', 11, 15, 'medium', '', NULL), (10, 'monocytes-percent', 'Monocytez %', 'T4', 3, NULL, NULL, NULL, '%', 'closed', 2, 10, 'medium', '', NULL),
    (11, 'glucose', 'Γλυκόζη', 'T2', 5000, NULL, NULL, NULL, 'mg/dL', 'maxOnly', NULL, 100, 'low', 'implausible-value', 'Βιοχημικές εξετάσεις'), (12, 'cholesterol', 'Cholesterol', 'T2', NULL, NULL, 'Ίχνη', 'Αρνητικό', NULL, NULL, NULL, NULL, 'high', '', 'Βιοχημικές εξετάσεις'),
    (13, 'plt', 'PLT', 'T1', -1, NULL, NULL, NULL, NULL, 'closed', 150, 400, 'high', '', 'Βιοχημικές εξετάσεις'), (14, 'x:another-thing', 'Another thing', NULL, -2, NULL, NULL, NULL, 'mg/dL', NULL, NULL, NULL, 'low', 'ambiguous-thousands,unparsed-range', 'Βιοχημικές εξετάσεις')"""


@query(f"""
    WITH e(source_order, marker_key, label, tier, base, comparator, text_value, categorical_reference, unit, range_kind, range_min, range_max, confidence, flags, section) AS (VALUES {_LAYOUT_ROWS})
    SELECT 's' || s_suppkey AS source_id, source_order, marker_key, label, tier, CASE WHEN base = -1 THEN 250.0 WHEN base = -2 THEN 1.234 WHEN base >= 0 THEN round(round(abs(s_acctbal), 2) % 5 + base, 1) END::DOUBLE AS value,
        CASE WHEN base IS NOT NULL THEN 'value' WHEN text_value IS NOT NULL THEN 'categorical' ELSE 'missing' END AS status, comparator, text_value, categorical_reference, unit, range_kind, range_min::DOUBLE AS range_min, range_max::DOUBLE AS range_max, confidence, flags, section
    FROM supplier, e""")
def parse_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no clean table has: two markers, wrapped labels, empty and nameless cells, words as values, whole lines; each anchor a row, each with its doubts."""
    p = extract.parse(printed_layouts(spark, sf_dir))
    return p.select("source_id", "source_order", "marker_key", "label", "tier", "value", "status", "comparator", "text_value", "categorical_reference", "unit", "range_kind", "range_min", "range_max", "confidence",
                    F.array_join("flags", ",").alias("flags"), "section")


@query("""SELECT 's' || s_suppkey AS source_id, CASE WHEN s_suppkey % 6 = 2 THEN 11 ELSE 12 END AS n_labels, s_suppkey % 6 <> 2 AS complete, 'name,national-id,patient-id' AS zones FROM supplier""")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata labels found on the first page of printed documents, one of which is missing from a sixth of them."""
    rows = extract.with_columns(layout.rows_of(layout.cluster_rows(printed_suppliers(spark, sf_dir, damaged=True))))
    return extract.coverage(rows, LABELS)
