"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions, one for each node of a 255-node byte tree; every node has
its own context tree over the preceding bytes. Each context keeps a Krichevsky-Trofimov estimate,
and the weighted probability of a context is half its own estimate plus half the product of its
children's, so all depths up to ``depth`` are mixed in proportion to how well they coded the
training text. Counts are sufficient: they are gathered once over the whole corpus, and texts are
then coded with the resulting mixture held fixed. A text ends with byte 0xFF, which UTF-8 never
holds, so the probabilities of all texts sum to one.

The tree itself grows with the corpus and is never cut or gathered in one place. All contexts that
share their ``TOP`` latest bytes make a subtree, built in the task that the counts are shuffled to; only
the contexts above, 257 at most, are mixed on the driver. Each byte gram that occurs in any text gets
its exact probability there. The ``MAX_GRAMS`` grams seen most often are looked up in the scan (67 MB, whatever
the corpus), all others are joined, so what is broadcast is bounded and the scores do not depend on it.
Words of the unigram base go the same way, long ones as digests: the at most ``MAX_WORDS`` most frequent are
looked up in the scan; all others are joined on the word. So no join key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

END = 0xFF
DEPTH, TOP, MAX_GRAMS, MAX_WORDS, LONG = 5, 2, 1 << 21, 1 << 16, 64
_FLUSH, _CHUNK = 200_000, 1 << 19


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2: Stirling's series after seven steps of the recurrence."""
    x = np.asarray(x, np.float64)
    low = np.ones_like(x)
    for i in range(7):
        low *= x + i
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    out, seen = np.zeros_like(n0), n0 + n1 > 0
    a, b = n0[seen], n1[seen]
    out[seen] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1.0)
    return out


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol counts (contexts, 256) to zeros and ones at the nodes 1..255 of the byte tree."""
    zeros, ones = np.zeros((len(counts), 256)), np.zeros((len(counts), 256))
    for k in range(8):
        split = counts.reshape(len(counts), 1 << k, 2, -1).sum(axis=3)
        zeros[:, 1 << k:2 << k], ones[:, 1 << k:2 << k] = split[:, :, 0], split[:, :, 1]
    return zeros, ones


_SYMBOL = np.arange(256)


def _log_bytes(p1: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probabilities of a one at every node."""
    out, log1, log0 = np.zeros((len(p1), 256)), np.log10(p1), np.log10(1 - p1)
    for k in range(8):
        node, bit = 1 << k | _SYMBOL >> (8 - k), _SYMBOL >> (7 - k) & 1
        out += np.where(bit, log1[:, node], log0[:, node])
    return out


class Mixture:
    """The mixture in one piece, for small trees: what the tests hold the distributed one against.

    The fixed predictive mixture over the contexts kept, whose suffixes are all kept too.

    ``levels`` gives, for each depth from 0 on, the sorted codes of the kept contexts (the latest
    byte leads) and their symbol counts (contexts, 256). What a context saw below contexts that
    were not kept makes one further child of it, a leaf.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not levels:
            levels = [(np.zeros(1, np.int64), np.zeros((1, 256)))]
        self.depth = len(levels) - 1
        codes = [c for c, _ in levels]
        up = [None, *[np.searchsorted(codes[d - 1], codes[d] >> 8) for d in range(1, len(levels))]]
        weight: list[np.ndarray] = [None] * len(levels)
        rest: list[np.ndarray] = [None] * len(levels)
        below = None
        for d in range(self.depth, -1, -1):
            own = _kt(*_nodes(levels[d][1]))
            if d == self.depth:
                weight[d], mixed = np.ones_like(own, np.float32), own
            else:
                rest[d] = levels[d][1].copy()
                np.subtract.at(rest[d], up[d + 1], levels[d + 1][1])
                children = _kt(*_nodes(rest[d]))
                np.add.at(children, up[d + 1], below)
                mixed = np.logaddexp(own, children) + np.log(0.5)
                weight[d] = np.exp(own + np.log(0.5) - mixed).astype(np.float32)
            below = mixed
        base = np.cumsum([0, *map(len, codes)])
        self.table = np.empty((base[-1], 256), np.float32)
        self.child = np.full((base[-1], 256), -1, np.int32)
        for d in range(self.depth + 1):
            for at in range(0, len(codes[d]), 2048):
                rows = np.arange(at, min(at + 2048, len(codes[d])))
                into = slice(base[d] + rows[0], base[d] + rows[-1] + 1)
                mix = 0.5
                if d < self.depth:
                    zeros, ones = _nodes(rest[d][rows])
                    mix = (ones + 0.5) / (zeros + ones + 1)
                for e in range(d, -1, -1):
                    zeros, ones = _nodes(levels[e][1][rows])
                    mix = weight[e][rows] * (ones + 0.5) / (zeros + ones + 1) + (1 - weight[e][rows]) * mix
                    rows = up[e][rows] if e else rows
                self.table[into] = _log_bytes(mix)
            if d:
                self.child[base[d - 1] + up[d], codes[d] & 255] = base[d] + np.arange(len(codes[d]))

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        out = np.zeros(len(texts))
        for lo, hi in _runs(texts):
            stream, starts, real = _stream(texts[lo:hi], self.depth)
            row = np.zeros(len(stream) - self.depth, np.int32)
            live = np.ones(len(row), bool)
            for i in range(self.depth):
                step = np.take(self.child, row << 8 | stream[self.depth - 1 - i:len(stream) - 1 - i])
                live &= step >= 0
                row = np.where(live, step, row)
            p = np.where(real, np.take(self.table, row << 8 | stream[self.depth:]), 0)
            out[lo:hi] = np.add.reduceat(p, starts, dtype=np.float64)
        return out


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _CHUNK bytes together, at least one text each."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if texts:
        yield lo, len(texts)


def _stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ends, where each text starts after the first ``depth``, which symbols count).

    Each text is coded as if it followed ``depth`` end bytes.
    """
    gap = bytes([END]) * max(1, depth)
    stream = np.frombuffer(gap[:depth] + gap.join(texts) + bytes([END]), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(lengths + len(gap))[:-1]]
    real = np.ones(len(stream) - depth, bool)
    for i in range(1, len(gap)):  # of the ends between two texts only the first is coded
        real[starts[:-1] + lengths[:-1] + i] = False
    return stream, starts, real


def _words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space; words over ``LONG`` bytes as a digest of 128 bits.

    A digest starts with a vertical tab, which no word holds, so all words can be looked up in the scan.
    """
    return [w if len(w) <= LONG else b"\x0b" + blake2b(w, digest_size=16).hexdigest().encode() for w in text.lower().split()]


def _codes(texts: list[bytes], depth: int) -> np.ndarray:
    """The grams of the texts in order, one for every byte and end.

    A gram is the ``depth`` bytes before a byte, the latest first, then the byte itself.
    """
    stream, _, real = _stream(texts, depth)
    code = np.zeros(len(stream) - depth, np.int64)
    for i in range(depth):
        code = code << 8 | stream[depth - 1 - i:len(stream) - 1 - i]
    return (code << 8 | stream[depth:])[real]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _gather(depth: int):
    """Counts of one partition's training words (the empty word is the end) and of all its byte grams.

    ``n`` counts where ``train`` holds, ``m`` everywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

        def out(w: list[bytes], nw: list[int], g: np.ndarray, ng: np.ndarray, learned: bool) -> pa.RecordBatch:
            word = pa.array([*w, *[None] * len(g)], pa.binary()).cast(pa.string())
            gram = pa.array(np.r_[np.zeros(len(w), np.int64), g], pa.int64(), mask=np.r_[np.ones(len(w), bool), np.zeros(len(g), bool)])
            m = np.r_[np.array(nw, np.int64), ng]
            return pa.RecordBatch.from_arrays([word, gram, pa.array(m * learned), pa.array(m)], ["word", "gram", "n", "m"])

        none = np.empty(0, np.int64)
        for b in batches:
            every, train = [t or b"" for t in b["text"].cast(pa.binary()).to_pylist()], b["train"].to_pylist()
            for learned, found in grams.items():
                texts = [t for t, y in zip(every, train, strict=True) if y == learned]
                if learned and texts:
                    for t in texts:
                        words.update(_words(t))
                        if len(words) > _FLUSH:
                            yield out([*words], [*words.values()], none, none, True)
                            words.clear()
                    words[b""] += len(texts)
                for lo, hi in _runs(texts):
                    found.append(np.unique(_codes(texts[lo:hi], depth), return_counts=True))
                    if sum(len(c) for c, _ in found[1:]) > 5 * _FLUSH:
                        found[:] = [_merged(found)]
                        if len(found[0][0]) > 5 * _FLUSH:
                            yield out([], [], *found.pop(), learned)
        if words:
            yield out([*words], [*words.values()], none, none, True)
        for learned, found in grams.items():
            if found:
                yield out([], [], *_merged(found), learned)

    return run


def _most_frequent(df: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the highest counts, ``most`` at most (all those above some count), and the others.

    The count is found from a histogram in steps of a sixteenth of a doubling.
    """
    stepped = df.withColumn("_step", F.floor(16 * F.log2(count)).cast("int"))
    total, least = 0, 1 << 30
    for step, rows in sorted(stepped.groupBy("_step").count().collect(), reverse=True):
        total += rows
        if total > most:
            break
        least = step
    return stepped.where(F.col("_step") >= least).drop("_step"), stepped.where(F.col("_step") < least).drop("_step")


def _shorter(code: np.ndarray, by: int) -> np.ndarray:
    """The grams without their ``by`` oldest bytes."""
    return code >> 8 * (by + 1) << 8 | code & 255


def _parent(key: np.ndarray, k: int) -> np.ndarray:
    """From (context, k bits) to the same bits under the context without its oldest byte."""
    return key >> (k + 8) << k | key & ((1 << k) - 1)


class _Subtree:
    """The contexts of ``top`` bytes and more over the given training grams (sorted) and counts.

    A key is a context followed by the k bits of the symbol that lead to a node.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        self.depth, self.top, self.levels = depth, top, {depth: (grams, n)}
        for d in range(depth - 1, top - 1, -1):
            codes, counts = self.levels[d + 1]
            self.levels[d] = _merged([(_shorter(codes, 1), counts)])

    def mixed(self, k: int) -> tuple[dict, np.ndarray]:
        """For each depth (keys, probability of a one, own weight) at bit k, and ln weighted probabilities at ``top``."""
        out, below = {}, None
        for d in range(self.depth, self.top - 1, -1):
            codes, n = self.levels[d]
            keys = codes >> (8 - k)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys = keys[starts]
            n1 = np.add.reduceat(n * (codes >> (7 - k) & 1), starts).astype(np.float64)
            n0 = np.add.reduceat(n, starts) - n1
            own = _kt(n0, n1)
            weight, whole = np.ones(len(keys)), own
            if d < self.depth:
                at = np.searchsorted(keys, _parent(out[d + 1][0], k))
                whole = np.logaddexp(own, np.bincount(at, below, len(keys))) + np.log(0.5)
                weight = np.exp(own + np.log(0.5) - whole)
            out[d], below = (keys, (n1 + 0.5) / (n0 + n1 + 1), weight), whole
        return out, below

    def ones(self, asked: np.ndarray, k: int) -> np.ndarray:
        """Probability of a one at bit k of the asked grams, from ``top`` down."""
        p = np.full(len(asked), 0.5)
        if not len(self.levels[self.depth][0]):
            return p
        levels, _ = self.mixed(k)
        for d in range(self.depth, self.top - 1, -1):
            keys, one, weight = levels[d]
            key = _shorter(asked, self.depth - d) >> (8 - k)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p = np.where(keys[at] == key, weight[at] * one[at] + (1 - weight[at]) * p, p)
        return p


def _subtrees(batches: Iterator[pa.RecordBatch], depth: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, n, m) of one or more whole subtrees; rows arrive sorted by gram."""
    rest = [np.empty(0, np.int64)] * 3
    for b in batches:
        rest = [np.concatenate([r, np.asarray(b[c])]) for r, c in zip(rest, ("gram", "n", "m"), strict=True)]
        if len(rest[0]) > _FLUSH:
            shard = rest[0] >> 8 * (depth + 1 - top)
            last = int(np.searchsorted(shard, shard[-1], "left"))
            if last:
                yield tuple(c[:last] for c in rest)
                rest = [c[last:] for c in rest]
    if len(rest[0]):
        yield tuple(rest)


def _upward(depth: int, top: int):
    """What the subtrees add to the contexts above them: (context and node, ln of the product)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, n, _ in _subtrees(batches, depth, top):
            learned = n > 0
            if not learned.any():
                continue
            tree = _Subtree(grams[learned], n[learned], depth, top)
            for k in range(8):
                levels, whole = tree.mixed(k)
                key, at = np.unique(_parent(levels[top][0], k), return_inverse=True)
                above = (key >> k) << 8 | 1 << k | key & ((1 << k) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(above), pa.array(np.bincount(at, whole))], ["above", "ln"])

    return run


def _coded(sent, depth: int, top: int):
    """Every gram with its count over all texts and its log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = sent.value
        for grams, n, m in _subtrees(batches, depth, top):
            tree, out = _Subtree(grams[n > 0], n[n > 0], depth, top), np.zeros(len(grams))
            for k in range(8):
                p = tree.ones(grams, k)
                node = 1 << k | (grams & 255) >> (8 - k)
                for d in range(top - 1, -1, -1):
                    one, weight = (t[grams >> 8 * (depth + 1 - d), node] for t in upper[d])
                    p = weight * one + (1 - weight) * p
                out += np.log10(np.where(grams >> (7 - k) & 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(m), pa.array(out)], ["gram", "m", "lp"])

    return run


def _probabilities(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, m, lp): log10 probability of every gram in the mixture over all contexts, from the counts (gram, n, m)."""
    top = min(TOP, depth)
    filed = grams.repartition(F.expr(f"shiftright(gram, {8 * (depth + 1 - top)})")).sortWithinPartitions("gram")
    upper: list[tuple[np.ndarray, np.ndarray]] = [None] * top
    if top:
        own = grams.where("n > 0").groupBy(F.expr(f"shiftright(gram, {8 * (depth + 2 - top)})").alias("c"), F.expr("gram & 255").alias("s")).agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((1 << 8 * (top - 1), 256))
        counts[np.asarray(own["c"]), np.asarray(own["s"])] = np.asarray(own["n"])
        sums = filed.mapInArrow(_upward(depth, top), "above long, ln double").groupBy("above").agg(F.sum("ln").alias("ln")).toArrow()
        below = np.zeros(counts.shape)
        below.reshape(-1)[np.asarray(sums["above"])] = np.asarray(sums["ln"])
        for d in range(top - 1, -1, -1):
            zeros, ones = _nodes(counts)
            alone = _kt(zeros, ones)
            whole = np.logaddexp(alone, below) + np.log(0.5)
            upper[d] = (ones + 0.5) / (zeros + ones + 1), np.exp(alone + np.log(0.5) - whole)
            if d:
                counts, below = counts.reshape(-1, 256, 256).sum(axis=1), whole.reshape(-1, 256, 256).sum(axis=1)
    sent = grams.sparkSession.sparkContext.broadcast(upper)
    return materialise(filed.mapInArrow(_coded(sent, depth, top), "gram long, m long, lp double"), "grams")


class _Lookup:
    """Grams to their log10 probabilities: open addressing, half full at most."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, depth: int) -> None:
        self.depth, self.bits = depth, max(4, (2 * len(grams) - 1).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at = self._slot(grams)
        while len(grams):
            free = self.keys[at] < 0
            self.keys[at[free]] = grams[free]
            placed = self.keys[at] == grams
            self.logs[at[placed]] = logs[placed]
            grams, logs, at = grams[~placed], logs[~placed], at[~placed] + 1 & (1 << self.bits) - 1

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probabilities, NaN for grams not held."""
        at = self._slot(grams)
        key = self.keys[at]
        out = np.where(key == grams, self.logs[at], np.nan)
        todo = np.flatnonzero((key != grams) & (key >= 0))
        at = at[todo]
        while len(todo):
            at = at + 1 & (1 << self.bits) - 1
            key, want = self.keys[at], grams[todo]
            same = key == want
            out[todo[same]] = self.logs[at[same]]
            on = ~same & (key >= 0)
            todo, at = todo[on], at[on]
        return out

    def log10(self, texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What the grams held add up to in each text, and (text, gram, times) of all others."""
        out, missed = np.zeros(len(texts)), []
        for lo, hi in _runs(texts):
            codes = _codes(texts[lo:hi], self.depth)
            sizes = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
            p = self.find(codes)
            lost = np.flatnonzero(np.isnan(p))
            p[lost] = 0
            out[lo:hi] = np.add.reduceat(p, np.cumsum(sizes) - sizes)
            row, gram = lo + np.searchsorted(np.cumsum(sizes), lost, "right"), codes[lost]
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])][:len(row)])
            missed.append((row[starts], gram[starts], np.diff(np.r_[starts, len(row)])))
        return out, tuple(np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*missed, strict=True) if missed else ((), (), ())))


def _emit(sent):
    """Per text a row with what its frequent grams and words add up to, and one for every other gram and word."""
    fields = ["doc_id", "h", "size", "word", "tf", "n", "k", "s", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t or b"" for t in b["text"].cast(pa.binary()).to_pylist()]
                rows, words, tfs, n, k, s = [], [], [], [], [], []
                for i, t in enumerate(texts):
                    all_words = _words(t)
                    known, total = 0, 0.0
                    for w, tf in Counter(all_words).items():
                        got = frequent.get(w)
                        if got is None:
                            rows.append(i)
                            words.append(w)
                            tfs.append(tf)
                        else:
                            known, total = known + tf, total + tf * got
                    n.append(len(all_words))
                    k.append(known)
                    s.append(total)
                scores, (lost, grams, times) = model.log10(texts)
                rows += lost.tolist()
                words += [b"\r%d" % g for g in grams.tolist()]  # no word has a carriage return either
                tfs += times.tolist()
                rest = len(words)
                row = pa.array([*range(len(texts)), *rows])
                own = [b"\n%d" % (x & 0xFFFFFF) for x in b["h"].to_pylist()]  # no word has a line feed: keys that spread and never match
                cols = [b[c].take(row) for c in ("doc_id", "h", "size")] + [pa.array(own + words, pa.binary()).cast(pa.string()), pa.array([0] * len(texts) + tfs, pa.int32())]
                cols += [pa.array([*map(kind.__call__, v), *[None] * rest]) for kind, v in ((int, n), (int, k), (float, s), (float, scores))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, kinds, strict=True)], fields)

    return run


def score(docs: DataFrame, train, depth: int = DEPTH, most: int = MAX_GRAMS) -> DataFrame:
    """Scores of all rows by the model and by the unigram base, both learned where ``train`` holds.

    ``train`` is a condition on the columns of ``docs``. Result: doc_id, n_tokens, n_known,
    train_tokens, base_score, score (log10) and bits_per_byte (code length per byte, the end
    counted as a byte). ``depth`` is 6 at most; ``most`` grams are looked up in the scan, which
    changes no score. Null texts count as empty; an empty text is its end alone. Repeated rows
    give equal rows. With nothing to learn from, the model is uniform and no token is known.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    counts = docs.select(text, F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(_gather(depth), "word string, gram long, n long, m long")
    counts = materialise(counts.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    known = counts.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    held, others = _most_frequent(_probabilities(counts.where(F.col("gram").isNotNull()).select("gram", "n", "m"), depth), "m", most)
    held = held.select("gram", "lp").toArrow()
    lookup = _Lookup(np.asarray(held["gram"]), np.asarray(held["lp"]), depth)
    top = _most_frequent(known.where(F.col("word") != ""), "c", MAX_WORDS)[0].toArrow()
    frequent = {w.encode(): float(np.log10(c + 1.0)) for w, c in zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)}
    sent = spark.sparkContext.broadcast((lookup, frequent))
    ends = known.where(F.col("word") == "").select("c").first()
    ends = ends[0] if ends else 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), text)
    found = rows.mapInArrow(_emit(sent), "doc_id long, h long, size int, word string, tf int, n long, k long, s double, score double")
    c = F.coalesce("c", F.lit(0))
    joined = known.withColumn("lp", F.lit(None).cast("double")).unionByName(others.select(F.concat(F.lit("\r"), F.col("gram").cast("string")).alias("word"), F.lit(None).cast("long").alias("c"), "lp"))
    found = found.join(joined.hint("shuffle_hash"), "word", "left")
    sums = found.groupBy("doc_id", "h").agg(
        F.count("score").alias("m"), F.max("n").alias("n"), F.max("size").alias("size"),
        (F.max("score") + F.coalesce(F.sum(F.col("tf") * F.col("lp")), F.lit(0.0)) / F.count("score")).alias("score"),
        F.sum(F.coalesce("k", F.when(c > 0, F.col("tf")).otherwise(0))).alias("k"), F.sum(F.coalesce("s", F.col("tf") * F.log10(c + F.lit(1.0)))).alias("s"))
    one = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    n = F.col("n") + 1
    known_tokens = (F.col("k") / F.col("m")).cast("long") + int(ends > 0)
    base = F.col("s") / F.col("m") + float(np.log10(ends + 1.0)) - n * F.log10(F.lit(float(total + distinct + 1)))
    return one.select("doc_id", n.alias("n_tokens"), known_tokens.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
                      (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("size") + 1)).alias("bits_per_byte"))
