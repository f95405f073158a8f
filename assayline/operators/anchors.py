"""Which markers a printed row names: runs of its tokens met with the registry, tier by tier, inside the row."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.lexical import GREEK, LATIN, fold_abbreviation, fold_label, fold_text, normalise_label
from ..functions.registry import MARKERS, Marker, names
from .match import greedy_of, nearest

LONGEST_RUN = 5
#: Parts over which the runs of one text are dealt where they meet what is near to it.
PARTS = 32
HIT = "struct<start:int,stop:int,marker:string,tier:string,text:string,first:int,last:int>"


_TOKEN = re.compile(r"(?:\S|[\x1c-\x1f])+")
_GLUED = re.compile(r".+(\([^()]*\))", re.DOTALL)
_READ = ("tokens array<string>, places array<int>, starts array<int>, stops array<int>, markers array<string>, tiers array<string>, texts array<string>, firsts array<int>, lasts array<int>, "
         "run_starts array<int>, run_stops array<int>, run_texts array<string>, run_norms array<string>, run_signs array<string>, run_firsts array<int>, run_lasts array<int>")


class Run(NamedTuple):
    """A run of a row's tokens: its text, its matching form, the % or # printed right after it, and the places of its first and last item."""

    start: int
    stop: int
    text: str
    norm: str
    sign: str
    first: int
    last: int


_fold = lru_cache(1 << 16)(fold_text)


@lru_cache(1 << 16)
def _code(norm: str) -> str:
    return re.sub(r"\s*([()])\s*", r"\1", norm).translate(_LATIN)


_LATIN = str.maketrans(GREEK, LATIN)


def token_runs(tokens: list[tuple[str, int]]) -> list[Run]:
    """All runs of one to five tokens, and bracketed codes printed without a blank before them."""
    out, norms = [], [_fold(t) for t, _ in tokens]
    for start in range(len(tokens)):
        for stop in range(min(start + LONGEST_RUN, len(tokens)), start, -1):
            sign = tokens[stop][0] if stop < len(tokens) and tokens[stop][0] in ("%", "#") else ""
            out.append(Run(start, stop, " ".join(t for t, _ in tokens[start:stop]), " ".join(filter(None, norms[start:stop])), sign, tokens[start][1], tokens[stop - 1][1]))
        if (m := _GLUED.fullmatch(tokens[start][0])):
            out.append(Run(start, start + 1, m[1], _fold(m[1]), "", tokens[start][1], tokens[start][1]))
    return out


class Dictionary:
    """A registry's codes and names in their matching forms; of two markers with one form the first has it."""

    def __init__(self, registry: list[Marker]) -> None:
        self.codes: dict[str, str] = {}
        self.names: dict[str, tuple[int, str]] = {}
        for n, m in enumerate(registry):
            for a in m.abbreviations:
                self.codes.setdefault(fold_abbreviation(a), m.key)
            for name in filter(None, [m.en, m.el, *m.aliases]):
                self.names.setdefault(fold_label(name), (n, m.key))
        self.sizes = sorted({n.count(" ") + 1 for n in self.names})

    def inside(self, norm: str) -> str | None:
        """The first marker, in the registry's order, whose name a text holds as whole words."""
        words = norm.split(" ")
        found = [self.names[w] for n in self.sizes for i in range(len(words) - n + 1) if (w := " ".join(words[i:i + n])) in self.names]
        return min(found)[1] if found else None

    def hits(self, runs: list[Run]) -> list[tuple[Run, str, str]]:
        """(run, marker, tier) of the first of three tiers that has any: a code, a name, a name inside the run as whole words.

        A bare code beside a bracketed one in the same item is prose; bracketed codes go before bare ones.
        """
        codes = [_code(r.norm) for r in runs]
        brackets = [len(c) > 1 and c[0] == "(" and c[-1] == ")" for c in codes]
        printed = [r for r, b in zip(runs, brackets, strict=True) if b]
        one = [(r, self.codes[k], b) for r, c, b in zip(runs, codes, brackets, strict=True) if (k := c[1:-1] if b else c) in self.codes and (b or not any(p.first <= r.last and p.last >= r.first for p in printed))]
        if one:
            return [(r, m, "T1") for r, m, b in one if b or not any(x[2] for x in one)]
        two = [(r, self.names[r.norm][1], "T2") for r in runs if r.norm in self.names]
        return two or [(r, m, "T3") for r in runs if (m := self.inside(r.norm))]


def chosen(hits: list[tuple[Run, str, str]]) -> list[tuple[Run, str, str]]:
    """The longest hits first, then the leftmost; none overlaps a kept one or repeats its marker. Left to right."""
    kept: list[tuple[Run, str, str]] = []
    for h in sorted(hits, key=lambda h: (h[0].start - h[0].stop, h[0].start)):
        if not any((k[0].start < h[0].stop and h[0].start < k[0].stop) or k[1] == h[1] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h[0].start)


def _read_rows(registry: list[Marker]):
    def run(items: pd.Series) -> pd.DataFrame:
        known, rows = Dictionary(registry), []
        for texts in items:
            tokens = [(t, n) for n, text in enumerate(texts) for t in _TOKEN.findall(text or "")]
            runs = token_runs(tokens)
            hits = chosen(known.hits(runs))
            rest = runs if not hits else []  # what is left to be met by distance
            rows.append(([t for t, _ in tokens], [n for _, n in tokens], [r.start for r, _, _ in hits], [r.stop for r, _, _ in hits], [m for _, m, _ in hits], [t for _, _, t in hits], [r.text for r, _, _ in hits], [r.first for r, _, _ in hits],
                         [r.last for r, _, _ in hits], *[[r[k] for r in rest] for k in range(len(Run._fields))]))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _READ.split(", ")])

    def kernel(items: pd.Series) -> pd.DataFrame:
        return run(items)

    return kernel


def near_hits(rows: DataFrame, registry: list[Marker] | None) -> DataFrame:
    """(source_id, row_no, hits) of rows that no exact tier knows: runs within a bounded number of edits of a name.

    ``rows``: (source_id, row_no, runs, section). Laboratories print the same few labels over and over: each distinct text meets the registry
    once. A share and a count are never near. Equally near names are told apart by the section, if just one belongs to it.
    """
    c = rows.select("source_id", "row_no", "section", F.explode("runs").alias("r")).select("source_id", "row_no", normalise_label(F.col("section")).alias("section"), "r.*").where(F.col("norm").rlike(r"\p{L}"))
    known = names(rows.sparkSession, registry).where("kind = 'alias'").select("ord", "marker_key", F.col("norm").alias("known"), normalise_label(F.col("section")).alias("hint"))
    sign = lambda x: F.when(F.contains(F.col(x), F.lit("%")), "%").when(F.contains(F.col(x), F.lit("#")), "#")
    met = nearest(c.select("norm", "sign").distinct(), known, "norm", "known", least_bound=1)
    met = met.where(F.coalesce(F.coalesce(sign("norm"), F.nullif("sign", F.lit(""))) == sign("known"), F.lit(True)))
    best = met.groupBy("norm", "sign").agg(F.min("distance").alias("d"), F.collect_set(F.struct("distance", "marker_key", "hint")).alias("all"))
    best = best.select("norm", "sign", F.filter("all", lambda a: a["distance"] == F.col("d")).alias("rivals"))
    # no size of ``best`` or ``late`` is known beforehand, so neither is broadcast; a label that every document prints is dealt over parts
    part = F.pmod(F.xxhash64("source_id", "row_no"), F.lit(PARTS)).cast("int")
    dealt = best.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    hits = c.withColumn("_part", part).join(dealt.hint("merge"), ["norm", "sign", "_part"])
    keys = lambda r: F.array_distinct(F.transform(r, lambda a: a["marker_key"]))
    here = keys(F.filter("rivals", lambda a: a["hint"] == F.col("section")))
    marker = F.when(F.size(keys(F.col("rivals"))) == 1, keys(F.col("rivals"))[0]).when(F.size(here) == 1, here[0])
    hits = hits.withColumn("marker", marker).where(F.col("marker").isNotNull()).withColumn("tier", F.lit("T4"))
    one = F.struct("start", "stop", "marker", "tier", "text", "first", "last").cast(HIT)
    return hits.groupBy("source_id", "row_no").agg(greedy_of(F.collect_list(one)).alias("hits"))


def with_anchors(rows: DataFrame, registry: list[Marker] | None = None, fuzzy: Column | None = None) -> DataFrame:
    """``rows`` with their ``placed`` tokens and ``anchors``: the markers a row names, left to right, none twice and none overlapping.

    ``rows``: (source_id, row_no, items, section). Exact tiers are settled inside the row, in Arrow batches and without a join; only rows that
    they leave without a hit, and that ``fuzzy`` allows, meet the registry by distance, and come back by their source's key.
    """
    named = lambda **c: F.arrays_zip(*[F.col(f"_k.{v}").alias(k) for k, v in c.items()])
    read = rows.withColumn("_k", pandas_udf(_read_rows(MARKERS if registry is None else registry), _READ)(F.transform("items", lambda i: i["text"])))
    read = read.withColumns({"placed": named(text="tokens", pos="places"), "anchors": named(start="starts", stop="stops", marker="markers", tier="tiers", text="texts", first="firsts", last="lasts").cast(f"array<{HIT}>"),
                             "runs": named(start="run_starts", stop="run_stops", text="run_texts", norm="run_norms", sign="run_signs", first="run_firsts", last="run_lasts")}).drop("_k")
    if fuzzy is None:
        return read.drop("runs")
    late = near_hits(read.where(fuzzy & (F.size("anchors") == 0)), registry).groupBy("source_id").agg(F.collect_list(F.struct("row_no", "hits")).alias("_late"))
    read = read.drop("runs").join(late.hint("merge"), "source_id", "left")
    found = F.get(F.filter("_late", lambda s: s["row_no"] == F.col("row_no")), F.lit(0))["hits"]
    return read.withColumn("anchors", F.when(F.size("anchors") > 0, F.col("anchors")).otherwise(F.coalesce(found, F.col("anchors")))).drop("_late")


def anchors(rows: DataFrame, fuzzy: bool = True, registry: list[Marker] | None = None) -> DataFrame:
    """(source_id, row_no, start, stop, marker, tier, text) of the markers that rows (source_id, row_no, items[, section]) name."""
    rows = rows if "section" in rows.columns else rows.withColumn("section", F.lit(None).cast("string"))
    found = with_anchors(rows.select("source_id", "row_no", "items", "section"), registry, F.lit(True) if fuzzy else None)
    return found.select("source_id", "row_no", F.inline("anchors")).select("source_id", "row_no", "start", "stop", "marker", "tier", "text")


def known_label(label: Column, registry: list[Marker] | None = None) -> Column:
    """The marker whose name a label is, or null."""
    names_ = {n: m for n, (_, m) in Dictionary(MARKERS if registry is None else registry).names.items()}
    table = F.from_json(F.lit(json.dumps(names_, ensure_ascii=False)), "map<string,string>")
    return F.element_at(table, normalise_label(label))


def box_of(items: Column, first: Column, last: Column) -> Column:
    """The box around the items from one place to another; a single item keeps its own width and height."""
    part = F.slice(items, first + 1, last - first + 1)

    def around(p: Column) -> Column:
        low = lambda f: F.array_min(F.transform(p, lambda i: i[f]))
        high = lambda f, g: F.array_max(F.transform(p, lambda i: i[f] + i[g]))
        one = F.size(p) == 1
        return F.struct(low("x").alias("x"), low("y").alias("y"), F.when(one, p[0]["w"]).otherwise(high("x", "w") - low("x")).alias("w"), F.when(one, p[0]["h"]).otherwise(high("y", "h") - low("y")).alias("h"))

    return F.transform(F.array(part), around)[0]
