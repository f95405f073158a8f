"""Rows read by their columns alone: each cell read once, in Arrow batches, as the column functions read it."""

from pyspark.sql import functions as F

from assayline.functions.numeric import parse_number, parse_range
from assayline.functions.units import is_known_unit, normalise_unit
from assayline.operators import extract
from assayline.operators.readout import range_of, unit_of, value_of
from assayline.plans import QUERIES

CELLS = ["", " ", "-", "5", "5,5", "5.123", "-0.5", "< 5", "<5", "≤ 7,25", "≥7", "> 5 x", "5 6", "abc", "Ίχνη θετικά", "1,234", "+12,345", "٣", "5 mg/dL", "μέχρι 5", "ΕΩΣ  7", "1-60", "1 - 60 k/μl", "60 - 1", "1 – 60 foo", "<5 %", "> 3",
         "mg / dL", "mg/dl x", "Κ/μL", "k/μl x", "gr/dl", "x10^3/µl y z", "%", "foo bar", "10^3 / µL", "9" * 400, "1 - 2", "\x1c5"]


def test_cells_are_read_as_the_column_functions_read_them(spark):
    rows = spark.createDataFrame([(c,) for c in CELLS], "c string")
    w = F.filter(F.split("c", r"(?U)\s+"), lambda x: x != "")
    run = lambda n: F.when(F.size(w) >= n, F.array_join(F.slice(w, 1, n), " "))
    known = F.coalesce(*[F.when(is_known_unit(run(n)), normalise_unit(run(n))) for n in (3, 2, 1)])
    tail = is_known_unit(F.get(w, F.size(w) - 1)) & (F.size(w) > 1)
    bounds = parse_range(F.array_join(F.when(tail, F.slice(w, 1, F.size(w) - 1)).otherwise(w), " "))
    got = rows.select("c", F.coalesce(parse_number(run(2)), parse_number(run(1))).alias("v"), F.coalesce(known, F.when(F.size(w) > 0, normalise_unit(F.array_join(w, " ")))).alias("u"), known.isNotNull().alias("k"), bounds.alias("r")).collect()
    for r in got:
        assert value_of(r.c)[:3] == (tuple(r.v) if r.v else (None, None, False)), r.c
        assert unit_of(r.c) == (r.u, r.k), r.c
        assert range_of(r.c)[:4] == (tuple(r.r) if r.r else (None,) * 4), r.c


def test_null_and_nameless_cells(spark):
    rows = [(1, "A", None, "mg/dL", "1-2"), (2, "A", "5", None, None), (3, " ", "5", "mg/dL", "1-2"), (4, None, "5", "mg/dL", "1-2"), (5, "A", "words", "foo", "x"), (6, "A", "1,234", "foo", "x y"), (7, "A", "few", "%", " none ")]
    frame = spark.createDataFrame([("s", *r) for r in rows], "source_id string, row_no int, c_label string, c_value string, c_unit string, c_range string")
    got = {r.row_no: (r.status, r.value, r.unit, r.range_kind, r.text_value, r.categorical_reference, r.flags) for r in extract.positional(frame).collect()}
    assert got == {1: ("missing", None, None, None, None, None, []), 2: ("value", 5.0, None, None, None, None, []), 6: ("value", 1.234, "foo", None, None, None, ["ambiguous-thousands", "unparsed-range", "unrecognised-unit"]),
                   7: ("categorical", None, None, None, "few", "none", ["unparsed-range"])}


def test_each_cell_is_read_once_and_after_repeated_rows_are_gone(spark):
    plan = QUERIES["positional_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert plan.count("ArrowEvalPython") == 1
    assert "regexp_extract" not in plan
    assert next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x) < next(i for i, x in enumerate(lines) if "HashAggregate" in x)
