"""Ranked lexical search over a clustered index whose documents are ordered by recursive graph bisection.

Building. A bisection tree is fitted on at most ``SAMPLE`` documents (those of the lowest hashes); every document of the
table follows its moves' gains down to a leaf, and leaves are dealt into pieces of about ``PIECE`` documents. Each piece is
bisected further where the shuffle brings it, until its runs hold ``CLUSTER`` documents with words in common. A cluster is one
row: its documents, its terms with their number of documents and best impact, and the postings.

Searching. Items are asked in blocks of about ``PAIRS`` terms, which go to where the index lies: nothing of the index is shuffled.
A cluster's bound for an item is the sum of weight times best impact over their common terms, from the clusters'
dictionaries alone. Clusters are visited in the order of their bounds, a growing number a round; an item is certain when no
cluster left can reach its k-th score. Nothing is cut: whatever could still enter the answer, ties included, is visited.
Documents are only reordered inside; answers carry their doc_id, which also settles ties.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Documents that the tree is fitted on, its depth, its term buckets; documents of a piece and of a cluster; bytes of a piece's terms.
SAMPLE, DEPTH, BUCKETS = 2048, 4, 1 << 16
PIECE, CLUSTER, PIECE_BYTES = 2048, 256, 48 << 20
ROUNDS = 8
#: Clusters of an item's first round, how much more each next round visits, terms of all items of one block.
FIRST, GROWTH, PAIRS = 8, 16, 1 << 18
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_READ = "leaf int, salt long, doc_id long, n long, terms binary, tf binary"
_INDEX = "cluster long, ids array<long>, terms array<string>, df array<int>, top array<long>, docs binary, impacts binary"


def term_counts(text: str | None) -> Counter:
    """The terms of a text, as UTF-8, with their occurrences."""
    return Counter(_TERM.findall((text or "").encode().translate(_FOLD)))


def _features(terms: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(t) & (BUCKETS - 1) for t in terms), np.int32, len(terms)))


# Bisection


def _cost(a: np.ndarray, b: np.ndarray, left: int, right: int) -> np.ndarray:
    """Bits that the gaps of a term's a left and b right documents take: the logarithmic gap cost of the halves."""
    return a * np.log2(left / (a + 1)) + b * np.log2(right / (b + 1))


def bisect(start: np.ndarray, terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left half?, documents of each term on the left, on the right) of documents given as a CSR matrix, none of them empty.

    The halves are equal; in each round documents are swapped in pairs, those that gain most first, until no pair gains.
    """
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    left = np.arange(n) < (n + 1) // 2
    n_left, n_right = int(left.sum()), int((~left).sum())
    total = np.bincount(terms, minlength=width)
    a = np.bincount(terms[left[owner]], minlength=width)
    for _ in range(ROUNDS):
        b = total - a
        now = _cost(a, b, n_left, n_right)
        leave, come = now - _cost(np.maximum(a - 1, 0), b + 1, n_left, n_right), now - _cost(a + 1, np.maximum(b - 1, 0), n_left, n_right)
        gain = np.add.reduceat(np.where(left[owner], leave[terms], come[terms]), start[:-1])
        out, in_ = np.flatnonzero(left), np.flatnonzero(~left)
        out, in_ = out[np.argsort(-gain[out], kind="stable")], in_[np.argsort(-gain[in_], kind="stable")]
        pairs = min(len(out), len(in_))
        swaps = int((gain[out[:pairs]] + gain[in_[:pairs]] > 1e-9).sum())
        if not swaps:
            break
        left[out[:swaps]], left[in_[:swaps]] = False, True
        a = np.bincount(terms[left[owner]], minlength=width)
    return left, a, total - a


def _rows(start: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, places) of some rows of a CSR matrix."""
    sizes = np.diff(start)[chosen]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return begin, np.repeat(start[chosen] - begin[:-1], sizes) + np.arange(begin[-1])


def clusters(start: np.ndarray, terms: np.ndarray, width: int, size: int) -> list[np.ndarray]:
    """The documents in bisected order, as runs of at most ``size``."""
    todo, out = [np.arange(len(start) - 1)], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        begin, places = _rows(start, part)
        left, _, _ = bisect(begin, terms[places], width)
        todo += [part[~left], part[left]]
    return out


def fit_tree(documents: list[np.ndarray], depth: int) -> np.ndarray:
    """What each bucket says about each node of a tree of bisections: cost on the left less cost on the right; nodes in heap order."""
    weights = np.zeros(((1 << depth) - 1, BUCKETS), np.float32)
    todo = [(0, documents)]
    while todo:
        node, part = todo.pop()
        if node >= len(weights) or len(part) < 4:
            continue
        start = np.concatenate([[0], np.cumsum([len(d) for d in part])])
        left, a, b = bisect(start, np.concatenate(part), BUCKETS)
        n_left, n_right = int(left.sum()) + 1, int((~left).sum()) + 1
        stay = _cost(a, b, n_left, n_right)
        weights[node] = (_cost(a + 1, b, n_left, n_right) - stay) - (_cost(a, b + 1, n_left, n_right) - stay)
        todo += [(2 * node + 1, [d for d, at in zip(part, left, strict=True) if at]), (2 * node + 2, [d for d, at in zip(part, left, strict=True) if not at])]
    return weights


def route(weights: np.ndarray, features: np.ndarray) -> int:
    """The leaf that a document's buckets lead to."""
    node = 0
    while node < len(weights):
        node = 2 * node + (1 if weights[node][features].sum() <= 0 else 2)
    return node - len(weights)


# The index


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_features(list(term_counts(t))) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["h"], pa.array([f.tobytes() for f in found], pa.binary())], ["h", "features"])


def _read(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows, out = b.slice(at, 256), []
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                    if found := term_counts(text):
                        tf = np.fromiter(found.values(), np.int64, len(found))
                        out.append((route(weights, _features(list(found))), seen, doc_id, int(tf.sum()), b" ".join(found), tf.tobytes()))
                        seen += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _READ.split(", ")])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m) with m = 50 + (50 * n * total) div length, in whole numbers."""
    if 50 * int(n.max(initial=0)) * total < 1 << 63:
        m = 50 + 50 * n * total // length
    else:
        m = np.array([50 + 50 * int(x) * total // length for x in n], np.int64)
    return 10**9 * tf // (1000 * tf + 20 * m)


def _indexed(total: int, length: int, size: int):
    """Pieces come as runs of rows; one is cut where it has twice as many documents as it should, or terms of more than ``PIECE_BYTES``."""
    def flush(key: tuple[int, int], first: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        terms = np.concatenate([np.fromiter((number.setdefault(t, len(number)) for t in r[2].split(b" ")), np.int64) for r in rows])
        tf = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        sizes = np.array([len(r[3]) // 8 for r in rows])
        start, n, names = np.concatenate([[0], np.cumsum(sizes)]), np.array([r[1] for r in rows], np.int64), list(number)
        impact = impacts(tf, np.repeat(n, sizes), total, length)
        for at, chosen in enumerate(clusters(start, terms, len(names), size)):
            begin, places = _rows(start, chosen)
            owner = np.repeat(np.arange(len(chosen), dtype=np.int32), np.diff(begin))
            order = np.argsort(terms[places], kind="stable")
            of, value = terms[places][order], impact[places][order]
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(((key[0] << 32) + key[1]) << 16) + first + at], pa.int64()), pa.array([[rows[i][0] for i in chosen]], pa.list_(pa.int64())),
                 pa.array([[names[t].decode() for t in of[edge]]], pa.list_(pa.string())), pa.array([np.diff(np.append(edge, len(of))).astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([np.maximum.reduceat(value, edge)], pa.list_(pa.int64())), pa.array([owner[order].tobytes()], pa.binary()), pa.array([value.astype(np.int32).tobytes()], pa.binary())],
                [f.split()[0] for f in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, taken, first = None, [], 0, 0
        for b in batches:
            for leaf, piece, *row in zip(*(b[c].to_pylist() for c in ("leaf", "piece", "doc_id", "n", "terms", "tf")), strict=True):
                if held and ((leaf, piece) != key or taken > PIECE_BYTES or len(held) >= 2 * PIECE):
                    yield from flush(key, first, held)
                    first, held, taken = first + len(held) if (leaf, piece) == key else 0, [], 0
                elif (leaf, piece) != key:
                    first = 0
                key = leaf, piece
                held.append(tuple(row))
                taken += len(row[2]) + len(row[3])
        if held:
            yield from flush(key, first, held)

    return run


def _terms(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(PATTERN), F.lit(0))


def build(docs: DataFrame, size: int = CLUSTER) -> tuple[DataFrame, int]:
    """(index, documents with a term): every document of ``docs`` that has a term is in one cluster of at most ``size``."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.size(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    rows, total, length = named.select(n.alias("n")).agg(F.count(F.lit(1)), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    hashed = named.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    drawn = hashed.where(F.pmod("h", F.lit(max(1, rows))) < 2 * SAMPLE).mapInArrow(_sampled, "h long, features binary").orderBy("h", "features").limit(SAMPLE).collect()
    sample = [f for f in (np.frombuffer(r.features, np.int32) for r in drawn) if len(f)]
    weights = fit_tree(sample, DEPTH)
    share = Counter(route(weights, f) for f in sample)
    pieces = [-(-total * share[leaf] // (max(1, len(sample)) * PIECE)) + 1 for leaf in range(1 << DEPTH)]
    piece = F.pmod("salt", F.get(F.array(*map(F.lit, pieces)), F.col("leaf")))
    dealt = named.mapInArrow(_read(weights), _READ).withColumn("piece", piece.cast("long")).repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "salt", "doc_id")
    return materialise(dealt.mapInArrow(_indexed(total, length, size), _INDEX), "index"), total


# The search


class Block:
    """Some items, as the executors see them: their terms by number, and which items ask for each term."""

    def __init__(self, terms: list[list[str]]):
        self.number = {t: i for i, t in enumerate(dict.fromkeys(t for item in terms for t in item))}
        self.of = [np.array([self.number[t] for t in item], np.int64) for item in terms]
        asked = np.concatenate([*self.of, np.empty(0, np.int64)])
        order = np.argsort(asked, kind="stable")
        self.items = np.repeat(np.arange(len(terms)), [len(o) for o in self.of])[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(asked, minlength=len(self.number)))])

    def places(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place in a cluster's dictionary, number) of the terms asked for that the cluster has."""
        found = [(p, self.number[t]) for p, t in enumerate(terms) if t in self.number]
        return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _bounded(block: Block, weight: np.ndarray):
    """(item, cluster, bound) from the clusters' dictionaries; clusters without a common term are no candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cluster, terms, top in zip(b["cluster"].to_pylist(), b["terms"], b["top"], strict=True):
                place, number = block.places(terms.values.to_pylist())
                begin, places = _rows(block.start, number)
                bound = np.zeros(len(block.of), np.int64)
                np.add.at(bound, block.items[places], np.repeat(weight[number] * np.asarray(top.values)[place], np.diff(begin)))
                item = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.full(len(item), cluster, np.int64)), pa.array(bound[item])], ["item", "cluster", "bound"])

    return run


def _scored(block: Block, weight: np.ndarray, floor: np.ndarray, k: int):
    """(item, doc_id, score): the k best documents of each cluster for each item that visits it, none below the item's floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                owner, impact = np.frombuffer(b["docs"][r].as_buffer(), np.int32), np.frombuffer(b["impacts"][r].as_buffer(), np.int32)
                ids = b["ids"][r].values
                doc, unknown = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
                edge = np.concatenate([[0], np.cumsum(np.asarray(b["df"][r].values))])
                place, number = block.places(b["terms"][r].values.to_pylist())
                place_of = np.full(len(block.number), -1, np.int64)
                place_of[number] = place
                out = ([], [], [])
                for item in b["items"][r].values.to_pylist():
                    mine = block.of[item][place_of[block.of[item]] >= 0]
                    begin, places = _rows(edge, place_of[mine])
                    score = np.zeros(len(doc), np.int64)
                    np.add.at(score, owner[places], impact[places].astype(np.int64) * np.repeat(weight[mine], np.diff(begin)))
                    near = np.flatnonzero(score >= floor[item])
                    near = near[np.lexsort((doc[near], unknown[near], -score[near]))[:k]]
                    out[0].append(np.full(len(near), item))
                    out[1].append(near)
                    out[2].append(score[near])
                item, near, score = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), ids.take(pa.array(near.astype(np.int64))), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _best(index: DataFrame, total: int, block: Block, k: int) -> DataFrame | None:
    """(item, doc_id, score, rank) of one block's items; None if no document has a term that is asked for."""
    spark, names = index.sparkSession, list(block.number)
    if not names:
        return None
    words = spark.createDataFrame(list(enumerate(names)), "number long, term string")
    counted = index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("df").alias("df")))).join(F.broadcast(words), "term").groupBy("number").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(names), np.int64)
    for r in counted.select("number", F.floor(1000 * F.log((2 * F.lit(total) + 2).cast("double") / (2 * F.col("df") + 1))).alias("w")).collect():
        weight[r.number] = r.w
    bounds = materialise(index.select("cluster", "terms", "top").mapInArrow(_bounded(block, weight), "item long, cluster long, bound long"), "bounds")
    floor, best, share, visited = np.ones(len(block.of), np.int64), None, FIRST, spark.createDataFrame([], "item long, last long, at long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    top = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    while True:
        floors = spark.createDataFrame(list(enumerate(floor.tolist())), "item long, floor long")
        left = bounds.join(F.broadcast(floors), "item").where(F.col("bound") >= F.col("floor")).join(F.broadcast(visited), "item", "left")
        left = left.where(F.col("last").isNull() | (F.col("bound") < F.col("last")) | ((F.col("bound") == F.col("last")) & (F.col("cluster") > F.col("at"))))
        todo = materialise(left.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= share).select("item", "cluster", "bound"), "todo")
        ends = todo.groupBy("item").agg(F.min(F.struct("bound", F.negative("cluster").alias("back"))).alias("v")).select("item", F.col("v.bound").alias("last"), F.negative("v.back").alias("at")).collect()
        if not ends:
            break
        grouped = todo.groupBy("cluster").agg(F.array_sort(F.collect_list("item")).alias("items"))  # a block's items at most
        scored = index.select("cluster", "ids", "terms", "df", "docs", "impacts").join(F.broadcast(grouped) if todo.count() <= PAIRS else grouped, "cluster").drop("cluster")
        scored = scored.mapInArrow(_scored(block, weight, floor, k), "item long, doc_id long, score long")
        both = scored if best is None else best.drop("rank").unionByName(scored)
        found = materialise(both.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "best")
        for old in (best, todo):
            if old is not None:
                discard(old)
        best, share = found, share * GROWTH
        for r in best.where(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
            floor[r.item] = r.score
        known = {r.item: (r.last, r.at) for r in visited.collect()} | {r.item: (r.last, r.at) for r in ends}
        visited = spark.createDataFrame([(i, *v) for i, v in known.items()], "item long, last long, at long")
    discard(bounds)
    return best


def search(index: DataFrame, total: int, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    ``items``: (item_id, text). Rows of one item_id are one item, which asks for the terms of all of them; a null id is an item too, a null
    text has no terms. ``index`` and ``total`` come from ``build``.
    """
    asked = items.select("item_id", F.explode(F.array_distinct(_terms("text"))).alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    asked = materialise(asked, "asked")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // PAIRS))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        best = _best(index, total, Block([r.terms for r in rows]), k)
        if best is not None:
            named = items.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
            found = best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of every item: ``build``, then ``search``.

    Every row of ``docs`` (doc_id, text) is a document of its own; a null text has no terms; a null doc_id takes part and comes last among
    equals. Repeated rows score alike and are all returned, with ranks of their own. Empty tables give no rows.
    """
    index, total = build(docs)
    found = materialise(search(index, total, items, k), "ranked")
    discard(index)
    return found
