"""Units: the printed forms' fold, the allowlist and the conversions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known units (micro sign U+00B5).
KNOWN = ["U/L", "mmol/L", "mg/dL", "µmol/L", "g/dL", "g/L", "µg/dL", "µg/L", "ng/mL", "ng/L", "pg/mL", "nmol/L", "mIU/L", "10^3/µL", "10^6/µL", "fL", "%", "pg", "mg/L",
         "mm", "IU/mL", "ng/dL"]
#: Printed forms after the fold.
PRINTED = {"u/L": "U/L", "µIU/mL": "mIU/L", "K/µL": "10^3/µL", "M/µL": "10^6/µL", "x10^3/µL": "10^3/µL", "x10^6/µL": "10^6/µL", "K/mL": "10^3/µL", "gr/dL": "g/dL"}
#: Marker, from, to, factor; back is division.
CONVERSIONS = [
    ("glucose", "mg/dL", "mmol/L", 0.05551), ("cholesterol", "mg/dL", "mmol/L", 0.02586), ("hdl", "mg/dL", "mmol/L", 0.02586), ("ldl", "mg/dL", "mmol/L", 0.02586),
    ("triglycerides", "mg/dL", "mmol/L", 0.01129), ("creatinine", "mg/dL", "µmol/L", 88.4), ("uric-acid", "mg/dL", "µmol/L", 59.48), ("haemoglobin", "g/dL", "g/L", 10.0),
    ("mchc", "g/dL", "g/L", 10.0), ("ferritin", "ng/mL", "µg/L", 1.0), ("vitamin-b12", "pg/mL", "ng/L", 1.0), ("folate", "ng/mL", "nmol/L", 2.266), ("vitamin-d", "ng/mL", "nmol/L", 2.496),
]


def normalise_unit(unit: Column) -> Column:
    """One spelling of a printed unit; null stays null."""
    u = F.regexp_replace(unit, r"(?U)\s+", "")
    u = F.translate(u, "μ", "µ")
    u = F.regexp_replace(F.regexp_replace(u, "Μ(?=/)", "M"), "[Κκk](?=/)", "K")
    u = F.regexp_replace(u, "l$", "L")
    table = F.create_map(*map(F.lit, chain.from_iterable(PRINTED.items())))
    return F.coalesce(F.element_at(table, u), u)


def fold_unit(unit: str) -> str:
    """``normalise_unit`` of one text, for the kernels that read rows in Arrow batches."""
    u = re.sub(r"[^\S\x1c-\x1f]+", "", unit).replace("μ", "µ")
    u = re.sub("[Κκk](?=/)", "K", re.sub("Μ(?=/)", "M", u))
    u = re.sub("l$", "L", u)
    return PRINTED.get(u, u)


def is_known_unit(unit: Column) -> Column:
    return normalise_unit(unit).isin(*KNOWN)


def conversions(spark: SparkSession, rows: list[tuple[str, str, str, float]] | None = None) -> DataFrame:
    """(marker_key, from_unit, to_unit, factor, forward) in both directions: a fixed, small table."""
    rows = CONVERSIONS if rows is None else rows
    both = [F.struct(F.lit(m).alias("marker_key"), F.lit(a).alias("from_unit"), F.lit(b).alias("to_unit"), F.lit(f).alias("factor"), F.lit(fw).alias("forward"))
            for m, x, y, f in rows for a, b, fw in ((x, y, True), (y, x, False))]
    return spark.range(1).select(F.inline(F.array(*both)))


def convert(value: Column, factor: Column, forward: Column) -> Column:
    """Multiply forward, divide back: 5 / f is not 5 * (1 / f) in the last bit."""
    return F.when(forward, value * factor).when(~forward, value / factor).otherwise(value)
