"""Printed document dates and civil moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_document_date(text: Column) -> Column:
    """dd-mm-yyyy, a real calendar day; else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(t, "dd-MM-yyyy"))


def moment(date: Column, time: Column) -> Column:
    """A timezone-free moment; a day without a time stands at noon."""
    return F.to_timestamp_ntz(F.concat(date.cast("string"), F.lit(" "), F.coalesce(time, F.lit("12:00"))), F.lit("yyyy-MM-dd HH:mm"))
