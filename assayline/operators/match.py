"""Matching labels to the registry: containment, tiers and span selection."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import deletions, fuzzy_bound, osa_distance
from ..functions.lexical import fold_text, normalise_label

_KEY_WORDS = 3
#: Characters of a dictionary that one automaton holds.
MOST_DICTIONARY = 1 << 22


def _windows(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many blank-separated words, for each size.

    The words are bound once as a lambda's variable: an expression used inside a lambda is evaluated for every element.
    """
    starts = lambda w, n: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i + n - 1 <= F.size(w))
    runs = lambda w, n: F.transform(starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.array_distinct(F.transform(F.array(F.split(text, " ", -1)), lambda w: F.concat(*[runs(w, n) for n in sizes]))[0])


def _scan(words: list[str]):
    """Which of the words each text, once normalised, holds between blanks: one pass of an Aho-Corasick automaton, built once a worker's task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for n, w in enumerate(words):
            automaton.add_word(f" {w} ", n)
        automaton.make_automaton()
        for b in batches:
            found = [sorted({n for _, n in automaton.iter(f" {fold_text(t)} ")}) if t else [] for t in b["text"].to_pylist()]
            kept = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(kept)), pa.array([n for f in found for n in f], pa.int32())], ["doc_id", "word_no"])

    return run


def contained(docs: DataFrame, items: DataFrame, most: int = MOST_DICTIONARY) -> DataFrame:
    """(doc_id, item_id): documents whose text contains an item's ``alias`` as whole words, once each.

    Both sides are normalised labels. A dictionary of at most ``most`` characters, which is measured first, becomes one automaton that every
    text passes through once; a larger one stays distributed (``contained_by_words``), with the same result. Empty aliases match nothing.
    """
    items = items.select("item_id", normalise_label(F.col("alias")).alias("alias")).where(F.col("alias") != "")
    distinct = items.select("alias").distinct()
    if (distinct.agg(F.sum(F.length("alias"))).first()[0] or 0) > most:
        return contained_by_words(docs, items)
    words = sorted(r.alias for r in distinct.collect())  # bounded by ``most``
    if not words:
        return docs.select("doc_id").join(items, F.lit(False)).select("doc_id", "item_id")
    hits = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word_no int").distinct()
    numbered = items.join(F.broadcast(items.sparkSession.createDataFrame(list(enumerate(words)), "word_no int, alias string")), "alias").select("word_no", "item_id").distinct()
    return hits.join(numbered, "word_no").select("doc_id", "item_id").distinct()


def contained_by_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contained`` for a dictionary of any size, its aliases normalised and not empty.

    A text that contains an alias contains its first words, three at most, so these are the join key whatever the alias's
    length; only ids and keys are spread, and the pairs found meet their texts again for the full test.
    """
    words = F.split("alias", " ", -1)
    keyed = items.withColumn("size", F.least(F.size(words), F.lit(_KEY_WORDS))).withColumn("key", F.array_join(F.slice(words, F.lit(1), F.col("size")), " "))
    sizes = sorted(r[0] for r in keyed.select("size").distinct().collect())
    texts = docs.select("doc_id", normalise_label(F.col("text")).alias("text"))
    if not sizes:
        return texts.join(keyed, F.lit(False)).select("doc_id", "item_id")
    spread = texts.select("doc_id", F.explode(_windows(F.col("text"), sizes)).alias("key"))
    near = spread.join(keyed.select("key", "item_id", "alias"), "key").select("doc_id", "item_id", "alias").distinct()
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return texts.join(near, "doc_id").where(F.contains(pad("text"), pad("alias"))).select("doc_id", "item_id").distinct()


def nearest(texts: DataFrame, known: DataFrame, text: str, name: str, least_bound: int = 0) -> DataFrame:
    """``texts`` joined to ``known`` where ``name`` is within ``text``'s bound of edits, with the ``distance``; both columns hold normalised labels.

    Both sides are spread to what is left of them after as many deletions as the bound allows, so near ones share a key and meet by an
    equi-join; the distance itself is computed for those pairs only. No text meets every name.
    """
    bound = fuzzy_bound(F.col(text))
    hashed = lambda a: F.transform(a, lambda t: F.xxhash64(t))
    left = texts.where(bound >= least_bound).select("*", F.explode(hashed(F.when(bound == 2, deletions(F.col(text), 2)).when(bound == 1, deletions(F.col(text), 1)).otherwise(F.array(text)))).alias("_key"))
    # names are spread for the largest bound; texts of another length than a name can have within two edits meet none
    right = known.select("*", F.explode(hashed(deletions(F.col(name), 2))).alias("_key"))
    met = left.join(right, "_key").drop("_key").distinct()
    return met.withColumn("distance", osa_distance(F.col(text), F.col(name), bound)).where(F.col("distance") <= bound)


def greedy_of(hits: Column) -> Column:
    """Of an array of spans (start, stop, marker, ...) the longest first, then leftmost; none may overlap a kept one or repeat its marker. Left to right.

    A row holds a few dozen spans at most, so the selection is a fold over its sorted array.
    """
    clash = lambda k, s: (k["start"] < s["stop"]) & (s["start"] < k["stop"]) | (k["marker"] == s["marker"])
    order = lambda s: F.struct(F.negative(s["stop"] - s["start"]).alias("n"), s["start"].alias("start"), s.alias("s"))
    ranked = F.transform(F.array_sort(F.transform(hits, order)), lambda o: o["s"])
    keep = lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s)), kept).otherwise(F.concat(kept, F.array(s)))
    return F.array_sort(F.aggregate(ranked, F.filter(hits, lambda s: F.lit(False)), keep))


def greedy(spans: DataFrame, row: str) -> DataFrame:
    """``greedy_of`` the spans (start, stop, marker) of each row."""
    picked = spans.groupBy(row).agg(greedy_of(F.collect_list(F.struct("start", "stop", "marker"))).alias("kept"))
    return picked.select(row, F.inline("kept")).select(row, "start", "stop", "marker")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) of all nodes that ``start`` (node) reaches over ``edges`` (a, b).

    Each round follows the edges of the nodes found last; lineage is cut by a checkpoint where the session has a
    folder for it. Rounds end when nothing is new, so cycles and chains of any length are fine.
    """
    keep = (lambda d: d.checkpoint()) if start.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d.cache())
    found = new = keep(start.select("node").distinct())
    while not new.isEmpty():
        new = keep(edges.join(new, edges["a"] == new["node"], "left_semi").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti"))
        found = keep(found.unionByName(new))
    return found
