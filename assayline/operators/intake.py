"""Intake: which files a batch accepts, and how raw fragments become positioned items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES, MOST_PAGES, MOST_BYTES = 20, 100, 50 * 1024 * 1024
JOIN_GAP, BASELINE = 0.5, 0.01


def is_pdf(name: Column, content: Column) -> Column:
    """The suffix and the first five bytes both say so."""
    return F.lower(name).endswith(".pdf") & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def route(files: DataFrame) -> DataFrame:
    """Each file of a batch with its outcome.

    ``files``: (batch_id, source_index, supported, n_bytes, pages, valid); pages are null where decoding failed. A
    batch of too many files is refused as a whole. Pages are counted over what was decoded; the file that crosses the
    budget ends the batch, and later ones are unread, whatever they are. Of the others type comes before size,
    then decoding, then the document gate.
    """
    batch = Window.partitionBy("batch_id")
    decoded = F.col("supported") & (F.col("n_bytes") <= MOST_BYTES) & F.col("pages").isNotNull()
    so_far = F.sum(F.when(decoded, F.col("pages")).otherwise(0)).over(batch.orderBy("source_index").rowsBetween(Window.unboundedPreceding, 0))
    counted = files.withColumn("n_files", F.count(F.lit(1)).over(batch)).withColumn("pages_so_far", so_far)
    crossing = F.min(F.when(F.col("pages_so_far") > MOST_PAGES, F.col("source_index"))).over(batch)
    outcome = (F.when(F.col("n_files") > MOST_FILES, "too-many-files").when(F.col("source_index") > F.col("_crossing"), "unread").when(F.col("source_index") == F.col("_crossing"), "page-budget")
               .when(~F.col("supported"), "unsupported-type").when(F.col("n_bytes") > MOST_BYTES, "too-large").when(F.col("pages").isNull(), "decode-failed")
               .when(~F.col("valid"), "not-a-document").otherwise("accepted"))
    return counted.withColumn("_crossing", crossing).withColumn("outcome", outcome).drop("_crossing")


def _join_page(pdf: pd.DataFrame) -> pd.DataFrame:
    """Items of one page: a fragment joins the open item if it is on its baseline, not left of its start, and nearly touches its end."""
    items: list[dict] = []
    for f in pdf.sort_values("frag").to_dict("records"):
        if f["text"] == "" or f["ascent"] == f["descent"]:
            continue
        head = items[-1] if items else None
        if head and abs(head["baseline"] - f["baseline"]) < BASELINE and f["x"] >= head["x"] and f["x"] - (head["x"] + head["w"]) < JOIN_GAP:
            head |= {"text": head["text"] + f["text"], "w": f["x"] + f["w"] - head["x"], "ascent": max(head["ascent"], f["ascent"]), "descent": min(head["descent"], f["descent"])}
        else:
            items.append(dict(f))
    out = pd.DataFrame(items, columns=pdf.columns)
    out["item"] = range(1, len(out) + 1)
    return out[["source_id", "page", "item", "text", "x", "baseline", "w", "ascent", "descent"]]


def rejoin(fragments: DataFrame) -> DataFrame:
    """Fragments (source_id, page, frag, text, x, baseline, w, ascent, descent) joined to the items of their page.

    The comparison is with the open item's own start, so fragments that drift apart do not chain; those
    without text or height are dropped. A page is one group, a few thousand fragments at most.
    """
    schema = "source_id string, page int, item int, text string, x double, baseline double, w double, ascent double, descent double"
    return fragments.groupBy("source_id", "page").applyInPandas(_join_page, schema)


def normalise_coordinates(items: DataFrame, width: float, height: float) -> DataFrame:
    """Page-normalised boxes from the top left, clamped to the page."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    x, top = clamp(F.col("x") / width), clamp((height - F.col("baseline") - F.col("ascent")) / height)
    w, h = F.col("w") / width, (F.col("ascent") - F.col("descent")) / height
    return items.select(*[c for c in ("source_id", "page", "item") if c in items.columns], "text", x.alias("x"), top.alias("y"), F.least(w, 1 - x).alias("w"), F.least(h, 1 - top).alias("h"))
