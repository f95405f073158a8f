"""Numbers, comparators and reference ranges as printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import normalise_label

#: A printed number, and one that could have thousands.
NUMBER = r"[+-]?\d+(?:[.,]\d+)?"
AMBIGUOUS = r"^[+-]?[1-9]\d{0,2}[.,]\d{3}$"
_COMPARATORS = "<>≤≥"
#: Words that print an upper bound, normalised.
UPPER_WORDS = ("εωσ", "μεχρι")


def to_double(text: Column) -> Column:
    """A printed number; decimal comma or point; anything else is null."""
    return F.when(text.rlike(f"^{NUMBER}$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def _comparator(sign: Column) -> Column:
    return F.when(sign == "≤", "<=").when(sign == "≥", ">=").when(sign.isin("<", ">"), sign)


def parse_number(text: Column) -> Column:
    """(value, comparator, ambiguous) of one token, or of a comparator and a number; else null.

    ``ambiguous``: three digits after one mark could be thousands; the value stays a decimal.
    """
    sign = F.regexp_extract(text, rf"^([{_COMPARATORS}]?)\s*({NUMBER})$", 1)
    number = F.regexp_extract(text, rf"^([{_COMPARATORS}]?)\s*({NUMBER})$", 2)
    parsed = F.struct(to_double(number).alias("value"), _comparator(sign).alias("comparator"), number.rlike(AMBIGUOUS).alias("ambiguous"))
    return F.when(number != "", parsed)


def _range(kind: Column, low: Column, high: Column, comparator: Column) -> Column:
    return F.struct(kind.alias("kind"), low.alias("min"), high.alias("max"), comparator.alias("comparator"))


def parse_range(text: Column) -> Column:
    """(kind, min, max, comparator) of a printed reference range; null if it is none."""
    return F.transform(F.array(normalise_label(text)), _parse_folded)[0]  # folded once, as a lambda's variable


def _parse_folded(t: Column) -> Column:
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
    upper = F.regexp_extract(t, rf"^(?:{'|'.join(UPPER_WORDS)})\s+({NUMBER})$", 1)
    sign = F.regexp_extract(t, rf"^([{_COMPARATORS}])\s*({NUMBER})$", 1)
    bound = F.regexp_extract(t, rf"^([{_COMPARATORS}])\s*({NUMBER})$", 2)
    comparator = _comparator(sign)
    low, high = (to_double(F.regexp_extract(t, rf"^({NUMBER})\s*[-–—]\s*({NUMBER})$", i)) for i in (1, 2))
    below = F.startswith(comparator, F.lit("<"))
    return (F.when(upper != "", _range(F.lit("maxOnly"), none, to_double(upper), F.lit("<=")))
            .when((bound != "") & below, _range(F.lit("maxOnly"), none, to_double(bound), comparator))
            .when(bound != "", _range(F.lit("minOnly"), to_double(bound), none, comparator))
            .when(low <= high, _range(F.lit("closed"), low, high, nothing)))


def close_to(expected: Column, actual: Column) -> Column:
    """Equality within the scorer's tolerance."""
    return F.abs(expected - actual) <= F.greatest(F.lit(1e-9), F.abs(expected) * 1e-6)


def range_status(value: Column, comparator: Column, kind: Column, low: Column, high: Column, strictness: Column) -> Column:
    """within, below, above or unavailable: a value against the range printed beside it."""
    under = F.when(kind == "closed", value < low).when(kind == "minOnly", F.when(strictness == ">", value <= low).otherwise(value < low)).otherwise(False)
    over = F.when(kind == "closed", value > high).when(kind == "maxOnly", F.when(strictness == "<", value >= high).otherwise(value > high)).otherwise(False)
    return F.when(value.isNull() | comparator.isNotNull() | kind.isNull(), "unavailable").when(under, "below").when(over, "above").otherwise("within")
