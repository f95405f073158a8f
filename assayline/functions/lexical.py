"""Text functions: label normalisation, tokens, slugs, identifiers and their removal."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition, marks dropped, is one other character, and those with a longer one.

    All of the basic plane but Hangul syllables, and the mathematical letters.
    """
    source, target, longer = [], [], {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.category(c).startswith("M"))
        if plain == char or (not plain and unicodedata.category(char).startswith("M")):
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            longer[char] = plain
    return "".join(source), "".join(target), longer


_FROM, _TO, _LONGER = _decompositions()
_LATIN_GREEK = [i for i, c in enumerate(_FROM) if c < "\u0400" or "\u1e00" <= c < "\u2000"]
_NEAR_FROM, _NEAR_TO = ("".join(t[i] for i in _LATIN_GREEK) for t in (_FROM, _TO))
def _ranges(codes: list[int]) -> str:
    """Sorted code points as the ranges of a character class."""
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    stops = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in zip(starts, stops, strict=True))


#: Texts of other characters than these need more than the short table: Latin, Greek and punctuation that no table spells out.
_PLAIN = [*range(0x400), *range(0x1E00, 0x2000), *(c for c in range(0x2010, 0x2033) if chr(c) not in _FROM)]
_RARE = "[^" + _ranges([c for c in _PLAIN if chr(c) not in _LONGER]) + "]"
#: Characters with a longer decomposition.
_SPELT = "[" + "".join(_LONGER) + "]"
#: Greek letters and the Latin ones they are confused with in codes.
GREEK, LATIN = "αβεζηικμνορτυχ", "abezhikmnoptyx"
#: Identifier patterns, in the order of their scan; word boundaries are ASCII.
IDENTIFIERS = [
    ("national-id", r"(?<![0-9A-Za-z_])\d{11}(?![0-9A-Za-z_])"),
    ("email", r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}"),
    ("phone", r"(?:\+30[\s-]?)?(?<![0-9A-Za-z_])(?:2\d|69)\d(?:[\s-]?\d){7}(?![0-9A-Za-z_])"),
]


#: Control characters, which no stored label may hold.
CONTROL = r"[\x00-\x1F\x7F]"


def normalise_label(text: Column) -> Column:
    """Compatibility letters, no marks, lower case, one sigma, single blanks; exact but for Hangul syllables and letters beyond the basic plane.

    For labels and inside lambdas; whole texts go through ``normalise_text``. ASCII texts need no table; texts of Latin and Greek letters
    take a short one, texts with a rarer character the whole one; only those with a character that is spelt out go through it
    character by character.
    """
    table = F.from_json(F.lit(json.dumps(_LONGER)), "map<string,string>")
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    full = F.translate(F.when(text.rlike(_SPELT), spelt).otherwise(text), _FROM, _TO)
    plain = F.when(text.rlike(_RARE), full).otherwise(F.translate(text, _NEAR_FROM, _NEAR_TO))
    full = F.regexp_replace(F.translate(F.lower(F.regexp_replace(plain, r"\p{M}", "")), "ς", "σ"), r"(?U)\s+", " ")
    return F.trim(F.when(text.rlike(r"^[\x21-\x7E]*$"), F.lower(text)).when(text.rlike(r"^[\x00-\x7F]*$"), F.regexp_replace(F.lower(text), r"\s+", " ")).otherwise(full))


#: Every combining mark, to be dropped; blanks as the column form sees them.
_MARKS = dict.fromkeys(c for c in range(0x110000) if unicodedata.category(chr(c)).startswith("M"))
_BLANKS = re.compile(r"[^\S\x1c-\x1f]+")


def fold_text(text: str) -> str:
    """``normalise_label`` of one whole text, for the kernels that read texts in Arrow batches; exact for every character."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    return _BLANKS.sub(" ", text.lower().replace("ς", "σ")).strip(" ")


def normalise_text(text: Column) -> Column:
    """``normalise_label`` of whole texts, in Arrow batches."""
    @pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fold_text(t) for t in texts], dtype=object)

    return folded(text)


def fold_label(text: str) -> str:
    """``normalise_label`` of a constant, on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    return " ".join(plain.lower().replace("ς", "σ").split())


def normalise_abbreviation(text: Column) -> Column:
    """Labels with blanks around brackets dropped and Greek look-alikes as Latin letters."""
    return F.translate(F.regexp_replace(normalise_label(text), r"\s*([()])\s*", "$1"), GREEK, LATIN)


def fold_abbreviation(text: str) -> str:
    """``normalise_abbreviation`` of a constant, on the driver."""
    return re.sub(r"\s*([()])\s*", r"\1", fold_label(text)).translate(str.maketrans(GREEK, LATIN))


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def derived_key(text: Column) -> Column:
    """The key of a label that the registry does not know."""
    slug = F.regexp_replace(F.regexp_replace(normalise_label(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.concat(F.lit("x:"), slug)


def identifiers(text: Column) -> Column:
    """All identifier findings of a text: array of (kind, found), in scan order."""
    parts = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _kinded(kind)) for kind, p in IDENTIFIERS]
    return F.concat(*parts)


def _kinded(kind: str):
    return lambda found: F.struct(F.lit(kind).alias("kind"), found.alias("found"))


def scrub(text: Column, found: Column) -> Column:
    """The text without any occurrence of the found strings; untouched if it holds none."""
    cut = F.aggregate(found, text, lambda t, f: F.replace(t, f, F.lit("")))
    return F.when(F.exists(found, lambda f: F.contains(text, f)), F.trim(F.regexp_replace(cut, r"(?U)\s+", " "))).otherwise(text)
