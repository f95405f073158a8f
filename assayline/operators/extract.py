"""From positioned text to parsed rows: the document gate, anchors and read-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_document_date
from ..functions.lexical import derived_key, fold_label, normalise_label, tokens
from ..functions.registry import Marker, markers
from ..functions.units import is_known_unit, normalise_unit
from .anchors import anchors, box_of, known_label, with_anchors
from .layout import BELOW_OVERLAP, BELOW_REACH, ROW_SHARE, cluster_rows, rows_of
from .outward import FAR, GAP
from .readout import read_columns, read_outward

#: The document template's title, metadata labels and column headings.
TITLE = "Αποτελέσματα Εργαστηριακών Εξετάσεων"
METADATA = ["Αρ. Υπόθεσης", "ΑΜΚΑ", "Επώνυμο", "Όνομα", "Αριθμός Παραγγελίας", "Ημερομηνία Λήψης Δείγματος", "Ημερομηνία Αποτελέσματος", "Επώνυμο Ιατρού", "Όνομα Ιατρού", "ΑΜΚΑ Ιατρού",
            "Ειδικότητα Ιατρού", "Επωνυμία Εργαστηρίου"]
COLLECTED, RESULTED = "Ημερομηνία Λήψης Δείγματος", "Ημερομηνία Αποτελέσματος"
HEADINGS = {"label": "Περιγραφή", "value": "Αποτέλεσμα", "unit": "Μονάδα Μέτρησης", "range": "Φυσιολογικές Τιμές", "notes": "Παρατηρήσεις"}
_ROLES = list(HEADINGS)

__all__ = ["anchors", "coverage", "gate", "gated", "headings", "parse", "positional", "with_columns"]


def _norm(text: str) -> Column:
    return F.lit(fold_label(text))


def with_columns(rows: DataFrame) -> DataFrame:
    """Rows with header flags, and the source's columns from its first header row as x_<role>."""
    rows = rows.withColumn("norm_text", normalise_label(F.col("text")))
    header = F.lit(True)
    for h in HEADINGS.values():
        header = header & F.col("norm_text").contains(_norm(h))
    rows = rows.withColumn("is_header", header)
    start = lambda role: F.array_min(F.transform(F.filter("items", lambda i: F.startswith(normalise_label(i["text"]), _norm(HEADINGS[role].split()[0]))), lambda i: i["x"]))
    whole = Window.partitionBy("source_id")
    first = F.min(F.when(F.col("is_header"), F.col("row_no"))).over(whole)
    rows = rows.withColumn("header_row", first)
    return rows.select("*", *[F.max(F.when(F.col("row_no") == F.col("header_row"), start(r))).over(whole).alias(f"x_{r}") for r in _ROLES])


def gated(rows: DataFrame) -> DataFrame:
    """The rows of accepted sources with their ``collected_date`` and ``result_date``: the gate's checks as windows, so rows are made once."""
    whole = Window.partitionBy("source_id")
    checks = rows.select("*", _label().alias("_label"))
    any_ = lambda c: F.coalesce(F.bool_or(c).over(whole), F.lit(False))
    seen = F.collect_set(F.when(F.col("_label").isin(*[fold_label(m) for m in METADATA]), F.col("_label"))).over(whole)
    dated = lambda name: F.min(F.when(F.col("_label") == _norm(name), F.struct("row_no", _value().alias("v")))).over(whole)["v"]
    checks = checks.select("*", any_((F.col("page") == 1) & F.col("norm_text").contains(_norm(TITLE))).alias("_title"), F.size(seen).alias("_seen"), dated(COLLECTED).alias("_printed"), dated(RESULTED).alias("_resulted"))
    table = F.col("x_label").isNotNull() & F.col("x_value").isNotNull() & F.col("x_unit").isNotNull() & F.col("x_range").isNotNull()
    checks = checks.withColumns({"collected_date": parse_document_date(F.col("_printed")), "result_date": parse_document_date(F.col("_resulted"))})
    return checks.where(F.col("_title") & (F.col("_seen") == len(METADATA)) & table & F.col("collected_date").isNotNull()).drop("_label", "_title", "_seen", "_printed", "_resulted")


def _label() -> Column:
    """What stands before a first-page row's colon, folded."""
    colon = F.instr("text", ":")
    return F.when((F.col("page") == 1) & (colon > 1), normalise_label(F.substring_index("text", ":", 1)))


def _value() -> Column:
    return F.trim(F.substr("text", F.instr("text", ":") + 1))


def gate(rows: DataFrame) -> DataFrame:
    """(source_id, ok, reject_reason, collected_date): the first check that fails names the reason.

    ``rows`` come from ``with_columns``.
    """
    rows, value = rows.withColumn("label_text", _label()), _value()
    label = F.col("label_text")
    g = rows.groupBy("source_id").agg(
        F.bool_or((F.col("page") == 1) & F.col("norm_text").contains(_norm(TITLE))).alias("title"),
        *[F.bool_or(F.coalesce(label == _norm(m), F.lit(False))).alias(f"m{i}") for i, m in enumerate(METADATA)],
        F.bool_and(F.least(*[F.col(f"x_{r}") for r in _ROLES]).isNotNull() & F.col("x_label").isNotNull() & F.col("x_value").isNotNull() & F.col("x_unit").isNotNull() & F.col("x_range").isNotNull()).alias("table"),
        F.min_by(F.when(label == _norm(COLLECTED), value), F.when(label == _norm(COLLECTED), F.col("row_no"))).alias("printed"))
    complete = F.lit(True)
    for i in range(len(METADATA)):
        complete = complete & F.col(f"m{i}")
    day = parse_document_date(F.col("printed"))
    reason = F.when(~F.col("title"), "missing-title").when(~complete, "missing-metadata").when(~F.coalesce("table", F.lit(False)), "missing-table").when(day.isNull(), "missing-date")
    return g.select("source_id", reason.isNull().alias("ok"), reason.alias("reject_reason"), day.alias("collected_date"))


def headings(rows: DataFrame) -> DataFrame:
    """Rows with ``is_heading`` and the ``section`` they stand in, from ``with_columns``.

    After the first table header a row is a heading if the next row is a table header or if it has nothing in the value,
    unit and range columns; a row's section is the last heading at or above it, across pages.
    """
    doc = Window.partitionBy("source_id").orderBy("row_no")
    in_cells = F.exists("items", lambda i: (i["x"] >= F.col("x_value")) & (i["x"] < F.coalesce("x_notes", F.lit(1.0))))
    ahead = F.coalesce(F.lead("is_header").over(doc), F.lit(False))
    rows = rows.withColumn("is_heading", (F.col("row_no") > F.col("header_row")) & ~F.col("is_header") & (ahead | ~in_cells))
    rows = rows.withColumn("is_heading", F.coalesce("is_heading", F.lit(False)))
    return rows.withColumn("section", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, 0)))


def _columns(role: str) -> tuple[Column, Column]:
    """Where a bound column begins and ends: at the next one's heading, or at the page's edge."""
    ends = dict(zip(_ROLES, [*[F.col(f"x_{r}") for r in _ROLES[1:]], F.lit(2.0)], strict=True))
    return F.col(f"x_{role}"), F.coalesce(ends[role], F.lit(2.0))


def _stands_in(item: Column, role: str) -> Column:
    low, high = _columns(role)
    centre = item["x"] + item["w"] / 2
    return (centre >= low) & (centre < high)


def _in_cell(role: str) -> Column:
    return F.filter("items", lambda i: _stands_in(i, role))


def _cell(role: str) -> Column:
    """The text of a row's cell in a bound column, read from top to bottom, so that a wrapped label comes together."""
    found = F.array_sort(F.transform(_in_cell(role), lambda i: F.struct(i["y"].alias("y"), i["x"].alias("x"), i["text"].alias("text"))))
    return F.array_join(F.transform(found, lambda i: i["text"]), " ")


def _tokens_of(items: Column, region: int, cell) -> Column:
    """Tokens with their region, their item's number and whether it stands in the value column."""
    return F.flatten(F.transform(items, lambda i: F.transform(tokens(i["text"]), lambda t: F.struct(t.alias("w"), F.lit(region).alias("r"), cell(i).alias("i"), _stands_in(i, "value").alias("v")))))


def _neighbours(rows: DataFrame) -> DataFrame:
    """One line an anchor with the tokens that it may read (``cells``), in order, and whether the next anchor or a gap ended the walk.

    What its own item goes on to say, unless that is a label cell; else the row to the right as far as the next anchor, what sits below it
    above the next anchor, and the row to the left. ``rows`` carry their anchors; every window is on the source's own partition.
    """
    page = Window.partitionBy("source_id", "page")
    boxed = F.transform("anchors", lambda a: F.struct(a.alias("hit"), box_of(F.col("items"), a["first"], a["last"]).alias("box")))
    rows = rows.withColumn("anchors", boxed)
    ys = F.flatten(F.collect_list(F.transform("anchors", lambda a: a["box"]["y"])).over(page))
    rows = rows.withColumn("_ys", ys).withColumn("_page", F.collect_list(F.when(F.size("items") > 0, F.struct("row_no", "items"))).over(page))
    a = rows.select("*", F.posexplode_outer("anchors").alias("nth", "a")).withColumns({"box": F.col("a.box"), "hit": F.col("a.hit")})
    right_edge, bottom = F.col("box.x") + F.col("box.w"), F.col("box.y") + F.col("box.h")
    bar_x = F.array_min(F.filter(F.transform("anchors", lambda o: o["box"]["x"]), lambda x: x > F.col("box.x")))
    bar_y = F.array_min(F.filter("_ys", lambda y: y > bottom))
    a = a.withColumns({"_bar_x": F.coalesce(bar_x, F.lit(FAR)), "_bar_y": F.coalesce(bar_y, F.lit(FAR)), "_reach": F.coalesce("x_unit", F.lit(0.0))})
    centre = F.col("box.y") + F.col("box.h") / 2
    beside = lambda i: F.abs(centre - (i["y"] + i["h"] / 2)) < ROW_SHARE * F.least(F.col("box.h"), i["h"])
    placed = F.transform("items", lambda i, p: F.struct(i.alias("i"), p.alias("p")))
    free = F.transform(F.filter(placed, lambda e: ~e["p"].between(F.col("hit.first"), F.col("hit.last")) & beside(e["i"])), lambda e: e["i"])
    overlap = lambda i: F.least(right_edge, i["x"] + i["w"]) - F.greatest(F.col("box.x"), i["x"])
    under = lambda i: (overlap(i) >= BELOW_OVERLAP * F.least(F.col("box.w"), i["w"])) & (i["y"] - bottom).between(0, BELOW_REACH * F.col("box.h")) & (i["y"] < F.col("_bar_y"))
    others = F.flatten(F.transform(F.filter("_page", lambda r: r["row_no"] != F.col("row_no")), lambda r: F.filter(r["items"], under)))
    below = F.transform(F.array_sort(F.transform(others, lambda i: F.struct(i["y"].alias("y"), i["x"].alias("x"), i["item"].alias("n"), i.alias("i")))), lambda e: e["i"])
    a = a.withColumns({"_right": F.filter(free, lambda i: i["x"] >= right_edge), "_left": F.reverse(F.filter(free, lambda i: i["x"] < F.col("box.x"))), "_below": below})
    first = F.get("_right", F.lit(0))["x"]
    gap = F.coalesce((first >= F.col("_reach")) & (first - right_edge > GAP), F.lit(False))
    walked = F.filter("_right", lambda i: ~gap & (i["x"] < F.col("_bar_x")))
    own = F.get("items", F.col("hit.first"))
    whole_line = F.coalesce((F.col("hit.first") == F.col("hit.last")) & ~(own["x"] + own["w"] <= F.col("x_value")), F.lit(False))
    rest = F.filter(F.transform("placed", lambda t, n: F.struct(t.alias("t"), n.alias("n"))), lambda e: (e["t"]["pos"] == F.col("hit.first")) & (e["n"] >= F.col("hit.stop")))
    tail = F.when(whole_line, F.transform(rest, lambda e: F.struct(e["t"]["text"].alias("w"), F.lit(0).alias("r"), F.lit(-1).alias("i"), F.lit(True).alias("v"))))
    item = lambda i: i["item"]
    around = F.concat(_tokens_of(walked, 1, item), _tokens_of(F.col("_below"), 2, item), _tokens_of(F.col("_left"), 3, item))
    a = a.withColumns({"_tail": tail, "_around": around, "_stopped": F.exists("_right", lambda i: i["x"] >= F.col("_bar_x")) | gap})
    lexical = F.coalesce(F.size("_tail") > 0, F.lit(False))
    a = a.withColumn("cells", F.when(F.col("hit").isNull(), F.array().cast("array<struct<w:string,r:int,i:int,v:boolean>>")).when(lexical, F.col("_tail")).otherwise(F.col("_around")))
    return a.withColumn("stopped", F.coalesce(~lexical & F.col("_stopped"), F.lit(False))).drop("_ys", "_page", "_bar_x", "_bar_y", "_reach", "_right", "_left", "_below", "_tail", "_around", "_stopped")


def parse(items: DataFrame, registry: list[Marker] | None = None) -> DataFrame:
    """Parsed rows of all accepted sources; nothing is read from a rejected one.

    ``items``: (source_id, page, item, text, x, y, w, h). Every marker that a row names is a row of the result, whatever its cells hold: it
    is read outward from where it is printed, with the table's columns to go by, and its unit from the unit column. Headings name no
    marker. A row below the first table header that names none is read by its columns (``positional``), and left out unless it has a
    label and a number, a known unit or a range. Rows come in printed order, markers of one row from left to right; flags
    say what is doubtful and lower the confidence. ``item_ids`` and the box (left, top, right, bottom) say where a row was
    read; ``text_start`` and ``text_end`` delimit the marker where one item holds all that was read.
    """
    table = gated(headings(with_columns(rows_of(cluster_rows(items)))))
    after = F.coalesce(F.col("row_no") > F.col("header_row"), F.lit(False)) & ~F.col("is_header")
    table = table.where(~F.col("is_heading"))
    read = _neighbours(with_anchors(table, registry, after))
    known = F.col("hit").isNotNull()
    read = read.where(known | after).withColumns({f"c_{r}": _cell(r) for r in ("label", "value", "unit", "range")})
    part = lambda f: F.transform("cells", lambda x: x[f])
    read = read.withColumn("k", read_outward(part("w"), part("r"), part("i"), part("v")))
    plain = positional_of(~known)  # only rows without a marker are read so
    dim = F.broadcast(markers(items.sparkSession, registry).select(F.col("marker_key").alias("_marker"), "low", "high"))
    read = read.withColumn("u", plain).where(known | F.col("u").isNotNull())
    key = F.coalesce("hit.marker", known_label(F.col("c_label"), registry), derived_key(F.col("c_label")))
    read = read.withColumn("marker_key", key).join(dim, F.col("marker_key") == F.col("_marker"), "left")
    either = lambda f: F.when(known, F.col(f"k.{f}")).otherwise(F.col(f"u.{f}"))
    out = read.withColumns({f: either(f) for f in ("status", "value", "comparator", "text_value", "categorical_reference", "range_kind", "range_min", "range_max", "range_comparator")})
    words = F.col("status") == "categorical"
    printed = F.trim("c_unit") != ""
    out = out.withColumn("unit", F.when(~words, F.when(known, F.when(printed, normalise_unit(F.trim("c_unit")))).otherwise(F.col("u.unit"))))
    doubts = {"unrecognised-unit": known & printed & ~F.coalesce(is_known_unit(F.trim("c_unit")), F.lit(False)), "implausible-value": ~F.col("value").between(F.col("low"), F.col("high")), "competing-anchor": F.size("anchors") > 1}
    out = out.withColumn("flags", F.concat(F.coalesce(either("flags"), F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(d, f) for f, d in doubts.items()]))))
    has = lambda *f: F.arrays_overlap("flags", F.array(*map(F.lit, f)))
    low = ~known | (F.col("status") == "missing") | has("ambiguous-thousands", "ambiguous-role", "implausible-value") | (F.col("stopped") & (~printed | F.col("range_kind").isNull()))
    medium = (F.col("hit.tier") == "T4") | F.col("comparator").isNotNull() | has("unparsed-range", "unrecognised-unit", "competing-anchor")
    order = F.row_number().over(Window.partitionBy("source_id").orderBy("row_no", "nth")) - 1
    out = out.withColumns({"source_order": order, "confidence": F.when(low, "low").when(medium, "medium").otherwise("high"), "label": F.coalesce("hit.text", "c_label")})
    out = _placed(out)
    return out.select("source_id", "collected_date", "result_date", "page", "row_no", "section", "source_order", "marker_key", "label", F.col("hit.tier").alias("tier"), "status", "value", "comparator", "text_value", "categorical_reference",
                      "unit", "range_kind", "range_min", "range_max", "range_comparator", "confidence", "flags", "item_ids", "box_left", "box_top", "box_right", "box_bottom", "text_start", "text_end")


def _placed(read: DataFrame) -> DataFrame:
    """Where each row was read: the marker's own items and the cells that its reading used, or the four cells of a row read by its columns."""
    anchor = F.slice("items", F.col("hit.first") + 1, F.col("hit.last") - F.col("hit.first") + 1)
    mine = F.concat(anchor, F.filter("items", lambda i: F.array_contains("k.used", i["item"])))
    cells = F.flatten(F.array(*[_in_cell(r) for r in ("label", "value", "unit", "range")]))
    read = read.withColumn("_used", F.when(F.col("hit").isNotNull(), mine).otherwise(cells))
    ids = F.when(F.col("hit").isNotNull(), F.concat(F.transform(anchor, lambda i: i["item"]), F.col("k.used"))).otherwise(F.transform("_used", lambda i: i["item"]))
    lowest = lambda f: F.array_min(F.transform("_used", lambda i: i[f]))
    highest = lambda f, g: F.array_max(F.transform("_used", lambda i: i[f] + i[g]))
    # the marker's offsets in its item: the blanks and tokens before it, found one after the other
    own = F.get("items", F.col("hit.first"))["text"]
    mine_ = F.filter(F.transform("placed", lambda t, n: F.struct(t.alias("t"), n.alias("n"))), lambda e: e["t"]["pos"] == F.col("hit.first"))
    spans = F.aggregate(mine_, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<n:int,a:int,z:int>>").alias("all")), lambda s, e: F.transform(F.array(F.call_function("locate", e["t"]["text"], own, s["at"] + 1) - 1),
                        lambda a: F.struct((a + F.length(e["t"]["text"])).alias("at"), F.concat(s["all"], F.array(F.struct(e["n"].alias("n"), a.alias("a"), (a + F.length(e["t"]["text"])).alias("z")))).alias("all")))[0], lambda s: s["all"])
    covered = F.filter(spans, lambda s: (s["n"] >= F.col("hit.start")) & (s["n"] < F.col("hit.stop")))
    read = read.withColumns({"item_ids": ids, "box_left": lowest("x"), "box_top": lowest("y"), "box_right": highest("x", "w"), "box_bottom": highest("y", "h")})
    read = read.withColumn("_spans", F.when((F.size("item_ids") == 1) & F.col("hit").isNotNull(), covered))
    stop = F.array_max(F.transform("_spans", lambda s: s["z"]))
    # a code printed without a blank before it is the end of its token
    begin = F.when((F.col("hit.stop") - F.col("hit.start") == 1) & F.startswith(F.col("hit.text"), F.lit("(")), stop - F.length("hit.text")).otherwise(F.array_min(F.transform("_spans", lambda s: s["a"])))
    return read.withColumns({"text_start": begin, "text_end": stop})


def positional_of(where: Column | None = None) -> Column:
    """The reading of a row by its cells c_label, c_value, c_unit and c_range alone; null for page furniture, and where ``where`` does not hold.

    The value is the longest beginning of its cell, two tokens at most, that is a number; a range cell may end in a known unit.
    """
    cells = [F.col(f"c_{r}") for r in ("label", "value", "unit", "range")]
    return read_columns(*cells if where is None else [F.when(where, c) for c in cells])


def positional(rows: DataFrame) -> DataFrame:
    """Rows without a known marker read by their bound columns alone: (source_id, row_no, label, marker_key, status, value, comparator, unit, range_kind, confidence, ...).

    ``rows``: (source_id, row_no, c_label, c_value, c_unit, c_range). Rows without a number, a known unit or a range are page furniture, and
    rows without a label are nameless: both are left out. Confidence is always low.
    """
    read = rows.withColumn("_p", positional_of()).where(F.col("_p").isNotNull())
    fields = ("status", "value", "comparator", "unit", "range_kind", "text_value", "categorical_reference", "range_min", "range_max", "range_comparator", "flags")
    return read.select("source_id", "row_no", F.col("c_label").alias("label"), derived_key(F.col("c_label")).alias("marker_key"), *[F.col(f"_p.{f}").alias(f) for f in fields], F.lit("low").alias("confidence"))


def coverage(rows: DataFrame, zones: dict[str, str]) -> DataFrame:
    """(source_id, n_labels, complete, zones): how many metadata labels the first page prints, and which of the given ones name a person.

    ``rows`` come from ``with_columns``; ``zones`` maps labels to kinds of identifiers, whose boxes are redacted.
    """
    known = rows.select("source_id", _label().alias("label")).where(F.col("label").isin(*[fold_label(m) for m in METADATA])).distinct()
    kinds = F.create_map(*[F.lit(x) for m, kind in zones.items() for x in (fold_label(m), kind)])
    g = known.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_labels"), F.array_sort(F.collect_set(F.element_at(kinds, F.col("label")))).alias("zones"))
    return g.select("source_id", "n_labels", (F.col("n_labels") == len(METADATA)).alias("complete"), F.array_join("zones", ",").alias("zones"))
