"""How values, ranges and dates are printed on the screens, and small facts about rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import parse_number, parse_range

#: Month names as dates print them.
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "el": ["Ιανουαρίου", "Φεβρουαρίου", "Μαρτίου", "Απριλίου", "Μαΐου", "Ιουνίου", "Ιουλίου", "Αυγούστου", "Σεπτεμβρίου", "Οκτωβρίου", "Νοεμβρίου", "Δεκεμβρίου"],
}


def localised_date(iso: Column, language: Column) -> Column:
    """Day, month's name, year and the ISO date in brackets; what is no date is echoed."""
    day = F.try_to_date(iso, "yyyy-MM-dd")
    names = F.when(language == "el", F.array(*map(F.lit, MONTHS["el"]))).otherwise(F.array(*map(F.lit, MONTHS["en"])))
    text = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.get(names, F.month(day) - 1), F.lit(" "), F.year(day).cast("string"), F.lit(" ("), iso, F.lit(")"))
    return F.when(day.isNull(), iso).otherwise(text)


def kind_of(status: Column, comparator: Column) -> Column:
    """missing, censored or value: what decides a point's colour and label."""
    return F.when(~status.eqNullSafe(F.lit("value")), "missing").when(comparator.isNotNull(), "censored").otherwise("value")


def percentage(correct: Column, total: Column) -> Column:
    """One decimal and a percent sign; a dash where nothing was asked."""
    tenths = F.round(correct * 1000 / total, 0).cast("long")
    text = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(total == 0, "—").otherwise(text)


def looks_numeric(token: Column) -> Column:
    """A plain number, a comparator with its number, or a range in one token."""
    return parse_number(token).isNotNull() | parse_range(token).isNotNull()


def split_glued(token: Column) -> Column:
    """A number with its unit glued on as two tokens; any other token as it is."""
    pattern = r"^([+-]?\d+(?:[.,]\d+)?)(\p{L}.*|%.*)$"
    number = F.regexp_extract(token, pattern, 1)
    return F.when(number != "", F.array(number, F.regexp_extract(token, pattern, 2))).otherwise(F.array(token))


def language_of(tags: Column, known: tuple[str, ...] = ("el", "en"), default: str = "el") -> Column:
    """The first known base language of a list of language tags."""
    bases = F.transform(tags, lambda t: F.lower(F.substring_index(t, "-", 1)))
    return F.coalesce(F.get(F.filter(bases, lambda b: b.isin(*known)), F.lit(0)), F.lit(default))


def collected_at(date: Column, time: Column) -> Column:
    """(date, time, precision): an empty time means that only the day is known."""
    given = F.when(F.trim(F.coalesce(time, F.lit(""))) != "", time)
    return F.struct(date.alias("date"), given.alias("time"), F.when(given.isNull(), "day").otherwise("minute").alias("precision"))


def valid_moment(date: Column, time: Column, precision: Column) -> Column:
    """A real day, and a real time exactly where the precision is the minute."""
    real = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull()
    timed = F.coalesce(time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))
    return F.coalesce(real, F.lit(False)) & F.when(precision == "minute", timed).when(precision == "day", time.isNull()).otherwise(False)


def measurement(row_fields: list[str]) -> list[Column]:
    """A parsed row's projection to a stored measurement: the label goes along only under a key derived from it."""
    return [*map(F.col, row_fields), F.when(F.startswith("marker_key", F.lit("x:")), F.col("label")).alias("label")]
