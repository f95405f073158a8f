"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints within ``RADIUS`` = 2 bits agree on at least four of six blocks of bits, so each
fingerprint is filed under the 15 choices of four blocks. All fingerprints filed under one such
key form a shard, and every link has both ends in some shard: the sharding loses nothing. A
BK-tree is grown per shard and searched along the edges within the radius only. Shard trees
travel by key to the task that holds their queries rather than by broadcast, since together
they grow with the corpus. A shard holds distinct fingerprints that share about 43 bits, so at
most 2**22 of them, whatever the number of copies.

A shard reports the links that join its trees into components (a spanning forest, at most one
per fingerprint); components over all shards come from alternating large-star and small-star
rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, spread_join, trim

RADIUS = 2
#: Differing bits up to which the fingerprints of sets are searched for sets that may be alike.
REACH = 16
#: Shingles whose frequency is looked up, shingles counted at a time, sets of a key in one tree, compared in one block, bits of a sketch.
MAX_COMMON, _CHUNK, _SHARD, _BLOCK, _BITS = 1 << 19, 1 << 20, 512, 2048, 2048
_CUTS = (0, 10, 20, 31, 42, 53, 64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text, as an unsigned number; no words: 0.

    Lower-cases A-Z only; words are runs without ASCII white space (\\x20, \\x09-\\x0D). Repeated
    shingles count each time. A bit is 1 if it is set in over half of the shingle hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    return _majority(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)))


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at:at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, key: int, radius: int) -> list[int]:
        """Numbers of all keys within the radius, following only edges that can hold one."""
        found, todo = [], [0] if self.keys else []
        keys, children = self.keys, self.children
        while todo:
            at = todo.pop()
            d = (keys[at] ^ key).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in children[at].items() if d - radius <= e <= d + radius]
        return found

    def add(self, key: int) -> int:
        """File the key; returns its number (that of an equal key if there is one)."""
        new = len(self.keys)
        at = 0
        while self.keys:
            d = (self.keys[at] ^ key).bit_count()
            if not d:
                return at
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                break
            at = nxt
        self.keys.append(key)
        self.children.append({})
        return new


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b["text"].cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(_CUTS, _CUTS[1:], strict=False)]
    unsigned = [sum(c) for c in combinations(blocks, len(blocks) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def _forest(fps: list[int], reps: list[int]) -> Iterator[tuple[int, int]]:
    """Links of one shard that join components, found while its BK-tree grows."""
    tree, parent = BKTree(), list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, key in enumerate(fps):
        for j in tree.near(key, RADIUS):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                yield reps[i], reps[j]
        tree.add(key)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard key; a shard may run over several batches."""
    rest = [np.empty(0, np.int64)] * 3

    def shards(cols: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        key, fp, rep = cols
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            yield from _forest(fp[s:s + n].view(np.uint64).tolist(), rep[s:s + n].tolist())

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(list(shards(cols)), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for b in batches:
        cols = [np.concatenate([r, np.asarray(b[c])]) for r, c in zip(rest, ("key", "fp", "rep"), strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if last:
            yield out([c[:last] for c in cols])
        rest = [c[last:] for c in cols]
    if len(rest[0]):
        yield out(rest)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) over representatives: enough links within the radius to join every component."""
    masks = F.array(*[F.lit(m) for m in _masks()])
    filed = nodes.select("fp", "rep", F.posexplode(masks).alias("choice", "mask"))
    filed = filed.select(F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "rep")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes that have an edge."""

    def starred(e: DataFrame, small: bool) -> DataFrame:
        """One star round: neighbours move to the smallest node of the neighbourhood."""
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if not small:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times")).withColumn("m", F.least("u", "m")), "stars")
        joined = spread_join(both, lowest, "u")
        lowest = lowest.drop("times")
        if small:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()

    now, before = materialise(edges.where(F.col("a") != F.col("b")).distinct(), "edges"), None
    while True:
        nxt = materialise(starred(starred(now, small=False), small=True), "edges")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(now)
        now = nxt
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows link at 2 or fewer differing bits; component_id is the smallest doc_id reachable, the
    row's own included. Null texts count as empty, and all texts without words share fingerprint
    zero. Rows of equal doc_id stay separate rows. A row with a null id joins its fingerprint's
    component but never names it. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times"))
    edges = links(nodes.where(F.col("rep").isNotNull()).drop("times"))
    comp = components(edges)
    classes = materialise(nodes.join(comp, nodes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "times"), "classes")
    return spread_join(fps, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted; a shorter text is one shingle."""
    words = text.lower().split()
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(width)), strict=False)] or [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def _least_common(n: int, least: float) -> int:
    """How many of its n shingles a set shares at least with any set of that likeness."""
    return int(np.ceil(n * least - 1e-9))


def _common(width: int):
    """The shingles that several of a few thousand texts share, and how many texts those are.

    Only the order of the hashes in ``_shingled`` hangs on these counts, and any order finds every
    pair: what a count leaves out costs time, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], ["hash", "times"])

        for b in batches:
            for t in b["text"].cast(pa.binary()):
                held.append(shingle_set(t.as_py() or b"", width))
                size += len(held[-1])
                if size > _CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        held.clear()
        trim()

    return run


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``MAX_COMMON`` shingles that most texts share, at most, sorted, and their numbers of texts."""
    counts = materialise(rows.select("text").mapInArrow(_common(width), "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times")), "common")
    steps = counts.groupBy(F.floor(8 * F.log2("times")).cast("int").alias("step")).count().collect()
    total, least = 0, None
    for step, n in sorted(steps, reverse=True):
        total += n
        if total > MAX_COMMON:
            break
        least = step
    if least is None:
        got = [np.empty(0, np.int64)] * 2
    else:
        found = counts.where(F.floor(8 * F.log2("times")) >= least).toArrow()
        got = [np.asarray(found["hash"]), np.asarray(found["times"])]
    discard(counts)
    order = np.argsort(got[0])
    return got[0][order], got[1][order]


def _shingled(width: int, least: float, sent):
    """Per row its set as a node (hash of the set), the set's size and fingerprint, and its rarest hashes, of which a partner has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = sent.value
        for b in batches:
            nodes, sizes, fps, prefixes, sketches = [], [], [], [], []
            for t in b["text"].cast(pa.binary()):
                s = shingle_set(t.as_py() or b"", width)
                keep = len(s) - _least_common(len(s), least) + 1
                rank = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, times[at], 0)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                fps.append(_majority(s.view(np.uint64)))
                prefixes.append(s[np.argsort(rank, kind="stable")[:keep]])
                sketches.append(np.packbits(np.bincount(s & _BITS - 1, minlength=_BITS).astype(np.uint8) & 1).view(np.int64))
            cols = [b["doc_id"], b["h"], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "node", "n", "fp", "prefix", "sketch"])

    return run


def _possible(least: float, na, nb, differing):
    """Whether two sets of these sizes can have the likeness, their sketches being so many bits apart.

    A sketch has the parity of the hashes in each of ``_BITS`` classes, so two sets differ in at least as many
    hashes as their sketches in bits: no pair of the likeness is left out.
    """
    return differing * (1 + least) <= (1 - least) * (na + nb) + 1e-6


def _file(tree: BKTree, places: list[list[int]], key: int, i: int) -> None:
    """Add the fingerprint of set i; ``places`` has the sets of each key of the tree."""
    at = tree.add(key)
    if at == len(places):
        places.append([])
    places[at].append(i)


def _sketched(least: float, n: np.ndarray, sketch: np.ndarray, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the others that can have the likeness to set i, and how far apart the sketches are."""
    others = others[np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]) - 1e-9]
    d = np.bitwise_count((sketch[others] ^ sketch[i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    near = _possible(least, n[others], n[i], d)
    return others[near], (d / (n[others] + n[i]))[near]


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]]:
    """Columns, sketches and keys (none where there is no such column) of rows sorted by the first column, cut between its values only."""
    cols, sketch, keys = [np.empty(0, np.int64)] * len(names), np.empty((0, _BITS // 64), np.int64), []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.concatenate([r, np.asarray(b[k])]) for r, k in zip(cols, names, strict=True)]
        sketch = np.concatenate([sketch, np.asarray(b["sketch"].flatten()).reshape(-1, _BITS // 64)])
        if "keys" in b.schema.names:
            keys += np.split(np.asarray(b["keys"].flatten()), np.cumsum(np.asarray(b["keys"].value_lengths()))[:-1])
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if last:
            yield [x[:last] for x in cols], sketch[:last], keys[:last]
            cols, sketch, keys = [x[last:] for x in cols], sketch[last:], keys[last:]
    if len(cols[0]):
        yield cols, sketch, keys


def _runs(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist()
    return zip(starts, [*starts[1:], len(ids)], strict=True)


def _nearest(least: float, reach: int):
    """Per set of a shard the nearest before it that its BK-tree holds within ``reach`` bits; rows arrive sorted by shard and node.

    The tree grows as it is searched. Of the sets found, the nearest by its sketch is reported, if any can have the likeness.
    """

    def found(cols: list[np.ndarray], sketch: np.ndarray) -> Iterator[tuple[int, int, float]]:
        shard, node, n, fp = cols
        for lo, hi in _runs(shard):
            tree, places = BKTree(), []
            for i, key in zip(range(lo, hi), fp[lo:hi].view(np.uint64).tolist(), strict=True):
                near = np.array([x for at in tree.near(key, reach) for x in places[at]], np.int64)
                near, apart = _sketched(least, n, sketch, i, near)
                if len(near):
                    best = int(apart.argmin())
                    yield int(node[i]), int(node[near[best]]), float(apart[best])
                _file(tree, places, key, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, sketch, _ in _whole(batches, ("shard", "node", "n", "fp")):
            pairs = list(zip(*found(cols, sketch), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(pairs, [pa.int64(), pa.int64(), pa.float64()], strict=True)], ["a", "b", "d"])
        trim()

    return run


def _apart(least: float, reach: int):
    """The possible pairs of a block in different components, with these and how far apart the sketches are; rows arrive sorted by block.

    A block holds one part of a key's sets, or two, whose sets are compared crosswise. Pairs within ``reach`` bits come from the
    BK-tree of the block's fingerprints, asked for every set outside the block's largest component; no other pair is in two
    components. Only fingerprints further apart than that are compared one by one, so that no pair is lost. A pair that meets
    under several keys is reported under the lowest.
    """
    names = ("block", "key", "node", "n", "c", "side", "fp")

    def batch(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found, strict=True) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["a", "b", "ca", "cb", "d"])

    def pairs(cols: list[np.ndarray], sketch: np.ndarray, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, key, node, n, c, side, fp = cols
        out = []
        for lo, hi in _runs(block):
            if (c[lo:hi] == c[lo]).all():
                continue
            held: dict[int, frozenset] = {}
            found, sizes = np.unique(c[lo:hi], return_counts=True)
            largest = found[sizes.argmax()]
            fps, tree, places = fp[lo:hi].view(np.uint64), BKTree(), []
            for i, x in enumerate(fps.tolist()):
                _file(tree, places, x, i)
            for i in lo + np.flatnonzero(c[lo:hi] != largest):
                met = np.bitwise_count(fps ^ fps[i - lo]) > reach
                met[[x for at in tree.near(int(fps[i - lo]), reach) for x in places[at]]] = True
                k = lo + np.flatnonzero(met & (c[lo:hi] != c[i]) & ((side[lo:hi] < 0) | (side[lo:hi] != side[i])) & ((c[lo:hi] == largest) | (np.arange(lo, hi) > i)))
                for x, apart in zip(*(v.tolist() for v in _sketched(least, n, sketch, i, k)), strict=True):
                    for y in (i, x):
                        if y not in held:
                            held[y] = frozenset(keys[y].tolist())
                    if min(held[i] & held[x]) == key[i]:
                        a, b = (i, x) if node[i] > node[x] else (x, i)
                        out.append((node[a], node[b], c[a], c[b], apart))
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
        yield batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, sketch, keys in _whole(batches, names):
            yield from pairs(cols, sketch, keys)
        trim()

    return run


def _alike(width: int, least: float):
    """The pairs whose sets have the likeness, computed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for ta, tb in zip(b["ta"].cast(pa.binary()), b["tb"].cast(pa.binary()), strict=True):
                x, y = shingle_set(ta.as_py() or b"", width), shingle_set(tb.as_py() or b"", width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                held.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(held, pa.bool_()))
        trim()

    return run


def _roots(parents: DataFrame) -> DataFrame:
    """(a, b): every node's root, from one smaller parent each, by pointer jumping: rounds as the logarithm of the depth."""
    now = materialise(parents, "parents")
    while True:
        up = now.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        nxt = materialise(now.join(up, now["b"] == up["_a"], "left").select("a", F.coalesce("_b", "b").alias("b"), F.col("_b").isNotNull().alias("moved")), "parents")
        moved = nxt.where("moved").limit(1).count()
        discard(now)
        now = nxt.drop("moved")
        now._shared_path = nxt._shared_path
        if not moved:
            return now


def _joined(links: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(a, b): every node's root once the linked nodes' trees are joined; None if no link joins two trees."""
    root = lambda x: F.coalesce(F.col(f"r{x}"), F.col(x)).alias(x)
    found = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select(root("a"), root("b"))
    found = materialise(found.where(F.col("a") != F.col("b")).distinct(), "links")
    if found.isEmpty():
        return None
    joined = materialise(components(found), "roots")
    whole = roots.join(joined.toDF("b", "component"), "b", "left").select("a", F.coalesce("component", "b").alias("b")).unionByName(joined.toDF("a", "b"))
    return materialise(whole, "roots")


def similar_components(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, h, component): rows with an id, ``h`` the hash of the text, linked where the Jaccard likeness of their
    shingle sets is ``least`` or more.

    Sets are found as op10's fingerprints are, by BK-trees in shards, and every pair found is compared exactly. Sets so alike
    differ in a dozen bits, too many for shards by blocks of bits. So a set is filed under its rarest hashes, so many that two
    sets of that likeness share one of them: no pair is lost, and a passage in many unlike texts files them together only if
    it is most of them. Of keys with the same sets under them one is kept; what is filed under a key is a shard, a large one in
    parts, which all hold its head (the smallest set).
    In the BK-tree of a shard's fingerprints each set is first compared to the nearest before it within ``REACH`` bits, which
    joins sets into components. Then all pairs of sets of a shard that are in different components are looked at, large shards in
    blocks: those within ``REACH`` bits by the trees again, those further apart, which no fingerprint shows, one by one. The
    nearest pair of every component is compared first, and then whatever is still apart.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(_frequent(rows, width))
    shingled = materialise(rows.mapInArrow(_shingled(width, least, sent), "doc_id long, h long, node long, n long, fp long, prefix array<long>, sketch array<long>"), "shingled")
    nodes = shingled.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.min(F.struct("n", "fp", "prefix", "sketch")).alias("set"))
    nodes = materialise(nodes.select("node", "row.doc_id", "row.h", "set.*"), "nodes")
    every = nodes.select(F.explode("prefix").alias("key"), "node")
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("head"), *members).where("times > 1")
    keys = materialise(keys.groupBy("times", "head", "m0", "m1").agg(F.min("key").alias("key")).drop("m0", "m1"), "keys")
    filed = materialise(spread_join(every, keys, "key"), "filed")
    discard(keys)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), distinct, that have the likeness."""
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc_id", "h"), "node")
        texts = materialise(rows.join(needed, ["doc_id", "h"]).groupBy("node").agg(F.first("text", ignorenulls=True).alias("text")), "texts")
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        out = materialise(both.mapInArrow(_alike(width, least), "a long, b long"), "links")
        discard(texts)
        return out

    part_of = lambda parts: F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")
    parts = F.ceil(F.col("times") / _SHARD).cast("int")
    treed = filed.select("key", "node", F.explode(F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(part_of(parts)))).alias("part"))
    treed = treed.select(F.xxhash64("key", "part").alias("shard"), "node").join(nodes.select("node", "n", "fp", "sketch"), "node").repartition("shard").sortWithinPartitions("shard", "node")
    pairs = treed.select("shard", "node", "n", "fp", "sketch").mapInArrow(_nearest(least, REACH), "a long, b long, d double").groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    roots = _roots(verified(materialise(pairs, "pairs")))
    placed = materialise(filed.join(roots.toDF("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("c")), "placed")
    discard(filed)
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("times")).where("c0 <> c1").select("key", "times")
    mixed = materialise(placed.join(materialise(mixed, "mixed"), "key"), "mixed")
    discard(placed)
    own_keys = mixed.groupBy("node").agg(F.collect_list("key").alias("keys"))  # a part of one set's hashes
    parts = F.ceil(F.col("times") / _BLOCK).cast("int")
    met = mixed.select("key", "node", "c", parts.alias("parts"), part_of(parts).alias("part")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "key", "node", "c", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).cast("long").alias("side"))
    met = met.join(nodes.select("node", "n", "fp", "sketch"), "node").join(own_keys, "node").repartition("block").sortWithinPartitions("block")
    apart = met.select("block", "key", "node", "n", "c", "side", "fp", "sketch", "keys").mapInArrow(_apart(least, REACH), "a long, b long, ca long, cb long, d double")
    apart = materialise(apart.distinct(), "apart")
    # first the nearest pair of every component, which joins most that belong together; then what is still apart
    ends = apart.select("a", "b", "d", F.explode(F.array("ca", "cb")).alias("c"))
    nearest = materialise(ends.groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    rest, joined = apart.join(nearest, ["a", "b"], "left_anti"), _joined(verified(nearest), roots)
    if joined is not None:
        roots = joined
        rest = rest.join(roots.toDF("ca", "ra"), "ca", "left").join(roots.toDF("cb", "rb"), "cb", "left").where(F.coalesce("ra", "ca") != F.coalesce("rb", "cb"))
    joined = _joined(verified(materialise(rest.select("a", "b"), "pairs")), roots)
    if joined is not None:
        roots = joined
    discard(nearest)
    for t in (mixed, nodes, apart):
        discard(t)
    return shingled.select("doc_id", "h", "node").join(roots.toDF("node", "root"), "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("component"))


def deduplicate(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of the smallest doc_id.

    Of rows repeated under that id with one text one stays; rows without an id stay. Texts under
    one id are told apart, so none is lost for its id.
    """
    members = similar_components(docs, width, least).groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("times"))
    keep = materialise(members.groupBy("component").agg(F.min(F.struct("doc_id", "h", "times")).alias("row")).select("row.*").toDF("_kept_id", "_kept_h", "_times"), "kept")
    rows = docs.withColumn("_h", F.xxhash64("text"))
    kept = rows.join(keep, (rows["doc_id"].cast("long") == keep["_kept_id"]) & (rows["_h"] == keep["_kept_h"]))
    once = kept.where("_times = 1").select(*docs.columns)
    repeated = kept.where("_times > 1").dropDuplicates(["doc_id", "_h"]).select(*docs.columns)
    return once.unionByName(repeated).unionByName(docs.where(F.col("doc_id").isNull()))
