"""Reading a printed row's cells: groups of tokens, their roles, and the row that comes of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions.lexical import fold_text
from ..functions.numeric import AMBIGUOUS, NUMBER, UPPER_WORDS
from ..functions.units import KNOWN, fold_unit

#: A printed number, one that could have thousands, a number with its unit glued on.
_NUMBER = re.compile(r"[+-]?\d+(?:[.,]\d+)?")
_AMBIGUOUS = re.compile(r"[+-]?[1-9]\d{0,2}[.,]\d{3}")
_GLUED_UNIT = re.compile(rf"({_NUMBER.pattern})([^\W\d_].*|%.*)")
_PAIR = re.compile(rf"({_NUMBER.pattern})\s*[-–—]\s*({_NUMBER.pattern})")
_SIGNS = {"<": "<", ">": ">", "≤": "<=", "≥": ">="}
_DASHES = ("-", "–", "—")
_UPPER = {"έως", "εως", "μέχρι", "μεχρι"}
MOST_UNIT_TOKENS = 3
SCHEMA = ("value double, comparator string, text_value string, categorical_reference string, range_kind string, range_min double, range_max double, range_comparator string, "
          "printed_unit string, flags array<string>, status string, used array<int>")


def _double(text: str) -> float:
    return float(text.replace(",", "."))


def _is_number(text: str) -> bool:
    return bool(_NUMBER.fullmatch(text))


def _known(unit: str) -> bool:
    return fold_unit(unit) in KNOWN


def _one_sided(sign: str, number: str) -> tuple:
    v = _double(number)
    return ("maxOnly", None, v, sign) if sign[0] == "<" else ("minOnly", v, None, sign)


def interval(tokens: list[str]) -> tuple | None:
    """(kind, low, high, comparator) if the tokens, joined, are one reference range."""
    text = " ".join(tokens)
    head, _, rest = text.partition(" ")
    if head.lower() in _UPPER and _is_number(rest):
        return "maxOnly", None, _double(rest), "<="
    if text[:1] in _SIGNS:
        rest = text[1:].strip()
        return _one_sided(_SIGNS[text[0]], rest) if _is_number(rest) else None
    m = _PAIR.fullmatch(text)
    return ("closed", _double(m[1]), _double(m[2]), None) if m and _double(m[1]) <= _double(m[2]) else None


@dataclass
class Group:
    """Tokens read as one thing: a number, a comparator with its number, or a range (bounds None: it does not parse)."""

    kind: str
    start: int
    stop: int
    value: str = ""
    sign: str = ""
    bounds: tuple | None = None


def split_glued(token: str) -> list[str]:
    """A number with its unit glued on as two tokens; any other token as it is."""
    m = _GLUED_UNIT.fullmatch(token)
    return [m[1], m[2]] if m else [token]


def groups(tokens: list[str], regions: list[int] | None = None) -> list[Group]:
    """Left to right; what is none of the three is passed over.

    The token after a range in the same region belongs to it unless it is a number or a dash: a known
    unit is dropped, anything else leaves a range that does not parse.
    """
    regions, out, i, n = regions or [0] * len(tokens), [], 0, len(tokens)

    def ranged(start: int, stop: int) -> Group:
        tail = tokens[stop] if stop < n and regions[stop] == regions[stop - 1] else None
        if tail is None or _is_number(tail) or tail in _DASHES:
            return Group("range", start, stop, bounds=interval(tokens[start:stop]))
        return Group("range", start, stop + 1, bounds=interval(tokens[start:stop + (not _known(tail))]))

    while i < n:
        t, nxt = tokens[i], tokens[i + 1] if i + 1 < n else ""
        if t[:1] in _SIGNS and _is_number(t[1:]):
            g = Group("comparator", i, i + 1, t[1:], _SIGNS[t[0]])
        elif t in _SIGNS and _is_number(nxt):
            g = Group("comparator", i, i + 2, nxt, _SIGNS[t])
        elif _is_number(t) and nxt in _DASHES and i + 2 < n and _is_number(tokens[i + 2]):
            g = ranged(i, i + 3)
        elif _is_number(t):
            g = Group("number", i, i + 1, t)
        elif t.lower() in _UPPER and _is_number(nxt):
            g = ranged(i, i + 2)
        elif interval([t]):
            g = ranged(i, i + 1)
        else:
            i += 1
            continue
        out.append(g)
        i = g.stop
    return out


def unit_window(tokens: list[str], regions: list[int], start: int) -> list[str]:
    """What may spell the unit of a value that ends at ``start``: tokens of its region up to a number, range, dash or comparator."""
    window = []
    for t, r in zip(tokens[start:], regions[start:], strict=True):
        if (start and r != regions[start - 1]) or _is_number(t) or t in _DASHES or t in _SIGNS or (t[:1] in _SIGNS and _is_number(t[1:])) or interval([t]):
            break
        window.append(t)
    return window


def unit_run(window: list[str]) -> str | None:
    """The longest beginning of the window, three tokens at most, that is a known unit."""
    runs = (" ".join(window[:k]) for k in range(min(MOST_UNIT_TOKENS, len(window)), 0, -1))
    return next((r for r in runs if _known(r)), None)


@dataclass
class Cells:
    """What a row's tokens say."""

    value: float | None = None
    comparator: str | None = None
    bounds: tuple | None = None
    unit: str | None = None
    flags: list[str] = field(default_factory=list)
    #: The tokens that value and range were read from, and the unit's.
    used: list[int] = field(default_factory=list)
    unit_used: list[int] = field(default_factory=list)


def roles(tokens: list[str], unit_known: bool = False, regions: list[int] | None = None, found: list[Group] | None = None) -> Cells:
    """The first plain number is the value, the first range the range, parsed or not.

    A comparator before any value is a censored value if a known unit follows (or stands in the unit column);
    otherwise it is passed over after a range, and doubtful before one. A comparator after the value is a
    one-sided range if there was no range yet.
    """
    regions = regions or [0] * len(tokens)
    out, seen, stop, doubtful, unparsed = Cells(), False, None, False, False
    for g in groups(tokens, regions) if found is None else found:
        if g.kind == "range":
            if not seen:
                out.bounds, unparsed, seen = g.bounds, g.bounds is None, True
                out.used += range(g.start, g.stop)
        elif stop is not None:
            if g.kind == "comparator" and not seen:
                out.bounds, seen = _one_sided(g.sign, g.value), True
                out.used += range(g.start, g.stop)
        elif g.kind == "number":
            out.value, stop = _double(g.value), g.stop
            out.used += range(g.start, g.stop)
            if _AMBIGUOUS.fullmatch(g.value):
                out.flags.append("ambiguous-thousands")
        else:
            sure = unit_known or unit_run(unit_window(tokens, regions, g.stop)) is not None
            if sure or not seen:
                out.value, out.comparator, stop, doubtful = _double(g.value), g.sign, g.stop, not sure
                out.used += range(g.start, g.stop)
                if _AMBIGUOUS.fullmatch(g.value):
                    out.flags.append("ambiguous-thousands")
    out.flags += ["ambiguous-role"] * doubtful + ["unparsed-range"] * unparsed
    window = unit_window(tokens, regions, stop) if stop is not None else []
    out.unit = unit_run(window) or (window[0] if window else None)
    out.unit_used = list(range(stop, stop + len(out.unit.split(" ")))) if out.unit else []
    return out


def read(tokens: list[str], in_value: list[bool], unit_known: bool = False, regions: list[int] | None = None, cells: list[int] | None = None, bound: bool = False) -> tuple:
    """One row of SCHEMA.

    Without any group the first cell is a categorical value, if it stands in the value column, and what
    follows in its region its reference; a lone dash is none. ``cells`` numbers the cell of each token, below 0 where
    a printed line goes on, whose tokens are cells of their own; without it all tokens of the value column are one cell.
    ``bound``: the unit has a column of its own, so no token is read for it.
    """
    regions = regions or [0] * len(tokens)
    found = groups(tokens, regions)
    got = roles(tokens, unit_known, regions, found)
    kind, low, high, sign = got.bounds or (None, None, None, None)
    text = reference = None
    used = got.used + ([] if bound else got.unit_used)
    if not found and tokens and in_value[0]:
        alike = [i for i in range(len(tokens)) if regions[i] == regions[0]]
        head = alike[:1] if cells and cells[0] < 0 else [i for i in alike if (cells[i] == cells[0] if cells else in_value[i])]
        words = " ".join(tokens[i] for i in head)
        if not all(c in _DASHES for c in words):
            text, reference = words, " ".join(tokens[i] for i in alike if i not in head) or None
            used = alike
    status = "categorical" if text else "value" if got.value is not None else "missing"
    return got.value, got.comparator, text, reference, kind, low, high, sign, got.unit, got.flags, status, list(dict.fromkeys(cells[i] for i in sorted(used) if cells[i] >= 0)) if cells else []


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])
    return out.astype({c: "float64" for c in ("value", "range_min", "range_max")})


def _read_all(tokens: pd.Series, in_value: pd.Series, known: pd.Series) -> pd.DataFrame:
    return _frame([read(list(t), list(v), bool(k)) for t, v, k in zip(tokens, in_value, known, strict=True)])


def _read_outward(bound: bool):
    def run(tokens: pd.Series, regions: pd.Series, cells: pd.Series, in_value: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r, c, v in zip(tokens, regions, cells, in_value, strict=True):
            split = [(x, reg, cell, inside) for word, reg, cell, inside in zip(t, r, c, v, strict=True) for x in split_glued(word)]
            rows.append(read([x[0] for x in split], [bool(x[3]) for x in split], False, [int(x[1]) for x in split], [int(x[2]) for x in split], bound))
        return _frame(rows)

    return run


def read_cells(tokens: Column, in_value: Column, unit_known: Column) -> Column:
    """A row read by its bound columns."""
    return pandas_udf(_read_all, SCHEMA)(tokens, in_value, unit_known)


def read_outward(tokens: Column, regions: Column, cells: Column, in_value: Column | None = None) -> Column:
    """A row read outward from its anchor: tokens with the region (0 its own item, 1 right, 2 below, 3 left) and the cell they stand in.

    ``in_value``, where columns are bound: whether the token's cell stands in the value column.
    """
    def run(tokens: pd.Series, regions: pd.Series, cells: pd.Series, in_value: pd.Series) -> pd.DataFrame:
        return kernel(tokens, regions, cells, in_value)

    kernel = _read_outward(in_value is not None)
    return pandas_udf(run, SCHEMA)(tokens, regions, cells, F.transform(cells, lambda c: F.lit(True)) if in_value is None else in_value)


#: What a row read by its columns alone comes to.
COLUMNS = ("struct<status:string,value:double,comparator:string,text_value:string,categorical_reference:string,unit:string,range_kind:string,range_min:double,range_max:double,"
           "range_comparator:string,flags:array<string>>")
_SIGNED = re.compile(rf"([<>≤≥]?)\s*({NUMBER})", re.ASCII)
_THOUSANDS = re.compile(AMBIGUOUS, re.ASCII)
_UPPER_BOUND = re.compile(rf"(?:{'|'.join(UPPER_WORDS)})\s+({NUMBER})", re.ASCII)
_CLOSED = re.compile(rf"({NUMBER})\s*[-–—]\s*({NUMBER})", re.ASCII)
_DOUBTS = ("ambiguous-thousands", "unparsed-range", "unrecognised-unit")


def _words(cell: str | None) -> list[str]:
    return re.findall(r"(?:\S|[\x1c-\x1f])+", cell or "")


@lru_cache(1 << 14)
def value_of(cell: str | None) -> tuple:
    """(value, comparator, ambiguous, text) of a value cell: the longest beginning, two tokens at most, that is a number, else its text; a cell that is null has none."""
    w = _words(cell)
    for n in (2, 1):
        if len(w) >= n and (m := _SIGNED.fullmatch(" ".join(w[:n]))):
            return _double(m[2]), _SIGNS.get(m[1]), bool(_THOUSANDS.search(m[2])), None
    return None, None, False, (cell or "").strip(" ") or None


@lru_cache(1 << 14)
def unit_of(cell: str | None) -> tuple:
    """(unit, known) of a unit cell: the longest beginning, three tokens at most, that is a known unit, else the whole cell."""
    w = _words(cell)
    for n in (3, 2, 1):
        if len(w) >= n and (u := fold_unit(" ".join(w[:n]))) in KNOWN:
            return u, True
    return (fold_unit(" ".join(w)) if w else None), False


@lru_cache(1 << 14)
def range_of(cell: str | None) -> tuple:
    """(kind, low, high, comparator, unparsed, text) of a range cell, which may end in a known unit."""
    w = _words(cell)
    text = fold_text(" ".join(w[:-1] if len(w) > 1 and _known(w[-1]) else w))
    bounds = None
    if m := _UPPER_BOUND.fullmatch(text):
        bounds = "maxOnly", None, _double(m[1]), "<="
    elif (m := _SIGNED.fullmatch(text)) and m[1]:
        bounds = _one_sided(_SIGNS[m[1]], m[2])
    elif (m := _CLOSED.fullmatch(text)) and _double(m[1]) <= _double(m[2]):
        bounds = "closed", _double(m[1]), _double(m[2]), None
    return *(bounds or (None, None, None, None)), bool(w) and bounds is None, (cell or "").strip(" ") or None


def _spread(cells: pa.Array, read, kinds: list[pa.DataType]) -> list[pa.Array]:
    """The columns of ``read`` for every cell; each distinct text of a batch is read once."""
    coded = pc.dictionary_encode(cells.cast(pa.string()), null_encoding="encode")
    found = [read(t) for t in coded.dictionary.to_pylist()]
    return [pa.array([f[k] for f in found], kind).take(coded.indices) for k, kind in enumerate(kinds)]


def _read_columns(label: pa.Array, value: pa.Array, unit: pa.Array, range_: pa.Array) -> pa.Array:
    text, number, yes = pa.string(), pa.float64(), pa.bool_()
    v, sign, ambiguous, words = _spread(value, value_of, [number, text, yes, text])
    u, known = _spread(unit, unit_of, [text, yes])
    kind, low, high, bound, unparsed, reference = _spread(range_, range_of, [text, number, number, text, yes, text])
    none, is_number = pa.scalar(None, text), pc.is_valid(v)
    wordy = pc.is_valid(words)
    # a null value cell is neither a number nor words, and its unit and range are not read
    plain = pc.and_(pc.invert(wordy), pc.is_valid(value))
    only = lambda c: pc.if_else(plain, c, pa.scalar(None, c.type))
    status = pc.if_else(is_number, "value", pc.if_else(wordy, "categorical", "missing"))
    doubts = [ambiguous, unparsed, pc.and_(pc.is_valid(u), pc.invert(known))]
    choice = pa.array([[f for i, f in enumerate(_DOUBTS) if k >> i & 1] for k in range(1 << len(_DOUBTS))], pa.list_(text))
    flags = choice.take(pc.add(pc.add(doubts[0].cast(pa.int32()), pc.multiply(doubts[1].cast(pa.int32()), 2)), pc.multiply(doubts[2].cast(pa.int32()), 4)))
    named = pc.fill_null(pc.not_equal(pc.utf8_trim(label.cast(text), " "), ""), False)
    kept = pc.and_(named, pc.or_(pc.or_(is_number, known), pc.is_valid(kind)))
    cols = [status, v, sign, words, pc.if_else(wordy, reference, none), only(u), only(kind), only(low), only(high), only(bound), flags]
    names = re.findall(r"(\w+):", COLUMNS)
    return pa.StructArray.from_arrays(cols, names, mask=pc.invert(kept))


def read_columns(label: Column, value: Column, unit: Column, range_: Column) -> Column:
    """The reading of a row by its four cells alone; null for page furniture, which has no label, or neither a number nor a known unit nor a range.

    Marked as not deterministic, so that a filter on what was read does not read every cell twice, and not before repeated rows are gone.
    """
    def run(label: pa.Array, value: pa.Array, unit: pa.Array, range_: pa.Array) -> pa.Array:
        return _read_columns(label, value, unit, range_)

    return arrow_udf(run, COLUMNS).asNondeterministic()(label, value, unit, range_)
