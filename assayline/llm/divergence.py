"""Source divergence audit: how far each source's words stray from the other sources of its language.

Terms are found at byte level: a lookup table over the batch's concatenated UTF-8 buffer lower-cases letters and marks
everything else, so boundaries are a comparison of neighbours. Slices are grouped by XXH64 and compared byte by byte
with the first of their group, so no collision joins two terms. Counts are combined per batch, then by Spark.

The kept vocabulary of a language is dealt into blocks; each block is a matrix of sources by terms in CSR form, whose
pairwise divergences are sums over the stored entries (``reduceat``) plus what the empty ones add in closed form.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE_DIGITS, LEAST_DOCS, TOP = 9, 10, 10
#: Bytes of text looked at together, and kept terms of one block.
RUN, BLOCK = 1 << 22, 1 << 15
_COUNTED = "lang string, source string, term string, n long, docs long"
_FOUND = "lang string, source string, part string, item string, value long"

#: Lower-case letter or byte beyond ASCII: itself; everything else ends a term.
LOOKUP = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint8)

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LANES = 32  # from this length on XXH64 works in stripes; such slices are rare and left to the library


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(rows: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of bytes, all of one length."""
    n, size = rows.shape
    if size >= _LANES:
        return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64)
    words, half, at = size // 8, size % 8 >= 4, size // 8 * 8
    h = np.full(n, _P5 + np.uint64(size), np.uint64)
    lanes = np.ascontiguousarray(rows[:, :at]).view("<u8").reshape(n, words)
    for k in range(words):
        h = _turn(h ^ (_turn(lanes[:, k] * _P2, 31) * _P1), 27) * _P1 + _P4
    if half:
        h = _turn(h ^ (np.ascontiguousarray(rows[:, at:at + 4]).view("<u4")[:, 0].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _turn(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def boundaries(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end in a looked-up buffer; none runs over the end of the text that it stands in."""
    inside = low != 0
    first = inside & np.r_[True, ~inside[:-1]]
    last = inside & np.r_[~inside[1:], True]
    full = ends > starts
    first[starts[full]] = inside[starts[full]]
    last[ends[full] - 1] = inside[ends[full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def grouped(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each slice's term, the terms): slices of one length and hash are one term if their bytes agree."""
    sizes, number, terms = end - begin, np.empty(len(begin), np.int64), []
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0]) if len(order) else []
    for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
        who = order[a:z]
        rows = low[begin[who][:, None] + np.arange(sizes[who[0]])]
        _, chosen, of = np.unique(hashes(rows), return_index=True, return_inverse=True)
        alike = (rows == rows[chosen][of]).all(axis=1)
        names = [r.tobytes() for r in rows[chosen]]
        if not alike.all():  # two terms share a hash: told apart by their bytes
            seen = {t: i for i, t in enumerate(names)}
            for i in np.flatnonzero(~alike):
                of[i] = seen.setdefault(rows[i].tobytes(), len(seen))
            names = list(seen)
        number[who] = of + len(terms)
        terms += names
    return number, terms


def _counted_run(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of some texts that lie behind one another in a buffer."""
    base = starts[0]
    low = LOOKUP[buffer[base:ends[-1]]]
    begin, end = boundaries(low, starts - base, ends - base)
    number, terms = grouped(low, begin, end)
    if not terms:
        return np.empty(0, np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.searchsorted(starts - base, begin, side="right") - 1
    pair, times = np.unique(doc * len(terms) + number, return_counts=True)
    key, of = np.unique(group[pair // len(terms)] * len(terms) + pair % len(terms), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, of, times)
    return key // len(terms), [terms[i] for i in (key % len(terms)).tolist()], n, np.bincount(of, minlength=len(key))


def _long_text(text: np.ndarray) -> Counter:
    """Occurrences of the terms of one text, looked at in pieces that end between terms."""
    found, at = Counter(), 0
    while at < len(text):
        stop, step = min(len(text), at + RUN), RUN
        while stop < len(text) and LOOKUP[text[stop - 1]] and LOOKUP[text[stop]]:
            gap = np.flatnonzero(LOOKUP[text[stop:stop + step]] == 0)
            stop = stop + int(gap[0]) if len(gap) else min(len(text), stop + step)
        low = LOOKUP[text[at:stop]]
        number, terms = grouped(low, *boundaries(low, np.array([0]), np.array([len(low)])))
        for t, n in zip(terms, np.bincount(number, minlength=len(terms)).tolist(), strict=True):
            found[t] += n
        at = stop
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        text = b["text"].cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        buffer = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        pairs = list(zip(b["lang"].to_pylist(), b["source"].to_pylist(), strict=True))
        numbers = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        group, names = np.array([numbers[p] for p in pairs], np.int64), list(numbers)
        at = 0
        while at < len(text):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN, side="right")) - 1)
            if offsets[stop] - offsets[at] > RUN:
                found = _long_text(buffer[offsets[at]:offsets[stop]])
                g, terms, n, docs = np.full(len(found), group[at]), list(found), np.array(list(found.values()), np.int64), np.ones(len(found), np.int64)
            else:
                g, terms, n, docs = _counted_run(buffer, offsets[at:stop], offsets[at + 1:stop + 1], group[at:stop])
            lang, source = (pa.array([p[k] for p in names], pa.string()).take(pa.array(g)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])
            at = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return read.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), exactly: a long division, three digits at a time."""
    below = np.asarray(total, np.int64) + 2 * kept
    if below.size and int(below.max()) >= 1 << 53:
        raise OverflowError("more than 2**53 terms in one group")
    out, rest = np.divmod(np.asarray(n, np.int64) + 2, below)
    for _ in range(SCALE_DIGITS // 3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) in whole numbers; shares stay below 2**30, so squares fit."""
    return (p - q) ** 2 // (p + q)


def _by_row(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the entries of each CSR row, empty rows included."""
    out, full = np.zeros(len(start) - 1, np.int64), start[1:] > start[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, start[:-1][full])
    return out


def pair_sums(column: np.ndarray, start: np.ndarray, p: np.ndarray, empty: np.ndarray, width: int) -> np.ndarray:
    """Divergence of every two rows of a CSR matrix of shares, summed over all ``width`` terms.

    ``empty`` is each row's share of a term that it lacks. Where both rows have an entry, or the second one, the sum runs over the
    second's entries; where only the first has one, over the first's, less what both have; the rest is alike for all.
    """
    rows = len(start) - 1
    owner, out = np.repeat(np.arange(rows), np.diff(start)), np.zeros((rows, rows), np.int64)
    stored = np.diff(start)
    for s in range(rows):
        mine = slice(start[s], start[s + 1])
        dense, has = np.full(width, empty[s]), np.zeros(width, bool)
        dense[column[mine]], has[column[mine]] = p[mine], True
        theirs, both = dense[column], has[column]
        out[s] = _by_row(apart(theirs, p), start) - _by_row(np.where(both, apart(theirs, empty[owner]), 0), start)
        for a in range(start[s], start[s + 1], 4096):
            out[s] += apart(p[a:min(a + 4096, start[s + 1])][:, None], empty[None, :]).sum(axis=0)
        out[s] += (width - stored[s] - stored + _by_row(both.astype(np.int64), start)) * apart(empty[s], empty)
    return out


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of one language's kept terms: the pair sums of its sources, and each source's most distinctive terms."""
    out = {c: [] for c in ("lang", "source", "part", "item", "value")}
    if terms.num_rows and groups.num_rows:
        lang, names = groups["lang"][0].as_py(), groups["source"].combine_chunks()
        total, kept = np.asarray(groups["total"]), groups["kept"][0].as_py()
        counts = terms["counts"].combine_chunks()
        start = np.asarray(counts.offsets) - counts.offsets[0].as_py()
        entries = counts.flatten()
        source, n = np.asarray(pc.index_in(entries.field("source"), names)).astype(np.int64), np.asarray(entries.field("n"))
        column = np.repeat(np.arange(terms.num_rows), np.diff(start))
        whole = share(np.add.reduceat(n, start[:-1]), total.sum(), kept)
        order = np.lexsort((column, source))
        column, p, by_source = column[order], share(n[order], total[source[order]], kept), np.r_[0, np.cumsum(np.bincount(source, minlength=len(names)))]
        sums = pair_sums(column, by_source, p, share(np.zeros(len(names), np.int64), total, kept), terms.num_rows)
        words, source_names = terms["term"].combine_chunks(), names.to_pylist()

        def add(i: int, part: str, items: list, values: list) -> None:
            for c, v in zip(out, ([lang] * len(items), [source_names[i]] * len(items), [part] * len(items), items, values), strict=True):
                out[c] += v

        for i in range(len(names)):
            mine = slice(by_source[i], by_source[i + 1])
            more = p[mine] > whole[column[mine]]
            place, value = column[mine][more], apart(p[mine][more], whole[column[mine][more]])
            near = np.flatnonzero(value >= np.partition(value, -TOP)[-TOP]) if len(value) > TOP else np.arange(len(value))
            best = sorted(((-int(value[j]), words[place[j]].as_py().encode()) for j in near))[:TOP]
            add(i, "term", [t.decode() for _, t in best], [-v for v, _ in best])
            others = [j for j in range(len(names)) if j != i]
            add(i, "pair", [source_names[j] for j in others], sums[i, others].tolist())
    return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from its language's other sources, and its ten most telling terms.

    A null text, lang or source counts as the empty one; every row of ``docs`` is a document of its own, repeated or not, and texts are read
    whole, however long. Groups whose texts hold no kept term take part with every count zero; a language without a kept term has pairs of
    value 0 and no terms. Equal values are ranked by the item's UTF-8 bytes. An empty table gives no rows.
    """
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = materialise(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    stats = materialise(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", zero("total"), zero("kept")), "groups")
    blocks = max(1, -(-kept.count() // BLOCK))
    left = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    right = stats.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = materialise(left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(lambda a, b: _block(a, b), _FOUND), "found")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = stats.select("lang", "source").join(stats.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", zero("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda d: d.withColumn("rank", rank)
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= TOP))
