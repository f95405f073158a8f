"""Identifier candidates of printed lines: labelled fields and scanned patterns, each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import fold_label, identifiers, normalise_label

#: Labels whose value identifies a person, with the kind of identifier.
LABELS = {"ΑΜΚΑ": "national-id", "ΑΜΚΑ Ιατρού": "national-id", "Επώνυμο": "name", "Όνομα": "name", "Επώνυμο Ιατρού": "name", "Όνομα Ιατρού": "name", "Αρ. Υπόθεσης": "patient-id", "Αριθμός Παραγγελίας": "patient-id", "Κωδικός": "patient-id"}


def candidates(lines: DataFrame) -> DataFrame:
    """(source_id, candidate_id, kind, found, known_position, page, line_no): lines are (source_id, page, line_no, text).

    The text before a line's first colon, taken whole, decides whether the rest is a labelled identifier; every line
    is scanned for patterns too. Of the same kind and text the first in reading order stays, and those left are numbered.
    """
    colon = F.instr("text", ":")
    known = F.create_map(*[F.lit(x) for label, kind in LABELS.items() for x in (fold_label(label), kind)])
    after = F.trim(F.substr("text", colon + 1))
    kind = F.when(colon > 1, F.element_at(known, normalise_label(F.substring_index("text", ":", 1))))
    labelled = F.when(kind.isNotNull() & (after != ""), F.array(F.struct(kind.alias("kind"), after.alias("found"), F.lit(True).alias("known_position"))))
    scanned = F.transform(identifiers(F.col("text")), lambda f: F.struct(f["kind"].alias("kind"), f["found"].alias("found"), F.lit(False).alias("known_position")))
    found = lines.select("source_id", "page", "line_no", F.posexplode(F.concat(F.coalesce(labelled, F.array().cast("array<struct<kind:string,found:string,known_position:boolean>>")), scanned)).alias("ord", "f"))
    place = F.struct("page", "line_no", "ord")
    first = found.groupBy("source_id", "f.kind", "f.found").agg(F.min(place).alias("p"), F.min_by("f.known_position", place).alias("known_position"))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("p"))
    return first.select("source_id", F.concat_ws(":", "source_id", F.lit("identifier"), n.cast("string")).alias("candidate_id"), "kind", "found", "known_position", "p.page", "p.line_no")
