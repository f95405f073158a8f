"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe and exact reranking.

A hash function turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the
nearest signed axis. Several functions in a row, the last over fewer axes, make one code; a table files every vector
under its code. Codes have so many bits that ``FILL`` vectors share one on average, and a query probes
``REACH * codes ** 0.6`` codes of every table, those of the axes next nearest first: what a query scans grows with the
0.6th power of the table. All vectors found under a probed code are compared exactly, in double precision.

Equal vectors are one class and filed once, with the few smallest ids that any answer can need, so no group of copies gathers in a
bucket. A shard is a run of codes; shards with many vectors are cut into pieces, and a query goes to each of them. A
query that finds fewer rows than it may return, since little lies near it, is asked again over all shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import materialise, spread_join
from .vector_classes import answers, best_classes, listed

TABLES, FILL, REACH, ROUNDS = 6, 24, 1.15, 3
PIECE, _CHUNK = 4096, 2048
_MET = "key long, piece long, side int, code long, codes binary, qno long, ids array<long>, v binary"


def _packed(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = np.asarray(b["v"].flatten(), kind), np.cumsum(np.asarray(b["v"].value_lengths()))
            parts = [flat[a:z].tobytes() for a, z in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(parts, pa.binary())], ["vec_id", "v"])

    return run


def usable(df: DataFrame, column: str) -> tuple[DataFrame, type]:
    """(vec_id, v as bytes) of the vectors that take part, each pair once, and the bytes' number type."""
    field = df.schema[column].dataType
    kind = np.float32 if isinstance(field, ArrayType) and isinstance(field.elementType, FloatType) else np.float64
    v = F.col(column) if kind is np.float32 else F.col(column).cast("array<double>")
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    kept = kept.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return kept.mapInArrow(_packed(kind), "vec_id long, v binary").distinct(), kind


def widths(dims: int, bits: int) -> list[int]:
    """The axes that each of a code's functions chooses from: all of them, and in the last as many as bits are left for."""
    full = 1 << max(0, dims - 1).bit_length()
    whole, rest = divmod(bits, full.bit_length())
    return [full] * whole + ([1 << (rest - 1)] if rest else [])


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Rows turned by rounds of random signs and Hadamard transforms; their length is a power of two."""
    n, size = x.shape
    for r in range(ROUNDS):
        x = x * np.random.default_rng((*seed, r)).choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            pair = x.reshape(n, -1, 2, h)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        x = x / np.sqrt(size)
    return x


def _signed(x: np.ndarray, dims: int, table: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(axes, coordinates along +a0, -a0, +a1, -a1, ...) of every function of one table."""
    padded = np.zeros((len(x), 1 << max(0, dims - 1).bit_length()))
    padded[:, :dims] = x
    for f, width in enumerate(widths(dims, bits)):
        turned = rotate(padded, (dims, table, f))[:, :width]
        yield width, np.stack([turned, -turned], axis=2).reshape(len(x), 2 * width)


def codes(x: np.ndarray, dims: int, table: int, bits: int) -> np.ndarray:
    """The code of each unit vector in one table."""
    out = np.zeros(len(x), np.int64)
    for width, along in _signed(x, dims, table, bits):
        out = out * (2 * width) + along.argmax(axis=1)
    return out


def probes(x: np.ndarray, dims: int, table: int, bits: int, count: int) -> np.ndarray:
    """The ``count`` codes of each unit vector whose axes lie nearest, by the squared distances to the nearest axes summed."""
    cost, found = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for width, along in _signed(x, dims, table, bits):
        order = np.argsort(-along, axis=1, kind="stable")[:, :count]
        best = np.take_along_axis(along, order, 1)
        cost = (cost[:, :, None] + ((best[:, :1] - best) ** 2)[:, None, :]).reshape(len(x), -1)
        found = (found[:, :, None] * (2 * width) + order[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(cost, axis=1, kind="stable")[:, :count]
        cost, found = np.take_along_axis(cost, keep, 1), np.take_along_axis(found, keep, 1)
    return found


def _matrices(column: pa.Array, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dims, row numbers, vectors scaled by a power of two, their lengths): a scale that no product overflows."""
    lengths = np.asarray(pc.binary_length(column)) // np.dtype(kind).itemsize
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        for at in range(0, len(rows), _CHUNK):
            part = rows[at:at + _CHUNK]
            x = np.frombuffer(b"".join(column.take(pa.array(part)).to_pylist()), kind).reshape(-1, dims).astype(np.float64)
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            yield dims, part, x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _key(dims: int, table: int, shard: np.ndarray) -> np.ndarray:
    return ((dims * TABLES + table) << 36) + shard


def _filed(kind: type, bits: int, shift: int, tables: int):
    """Every class once a table: (key, salt, code, ids, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, rows, x, norm in _matrices(b["v"], kind):
                for t in range(tables):
                    code, at = codes(x / norm[:, None], dims, t, bits), pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(_key(dims, t, code >> shift)), b["salt"].take(at), pa.array(code), b["ids"].take(at), b["v"].take(at)], ["key", "salt", "code", "ids", "v"])

    return run


def _asked(kind: type, bits: int, shift: int, tables: int, count: int | None):
    """Every query once a shard that it probes, with the codes there: (key, codes, qno, v). Without a count, all shards of all codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, rows, x, norm in _matrices(b["v"], kind):
                for t in range(tables):
                    if count is None:
                        shards = np.tile(np.arange(1 << (bits - shift)), len(rows))
                        who, lists = np.repeat(np.arange(len(rows)), 1 << (bits - shift)), [b""] * len(shards)
                    else:
                        near = np.sort(probes(x / norm[:, None], dims, t, bits, count), axis=1)
                        flat, owner = near.ravel(), np.repeat(np.arange(len(rows)), near.shape[1])
                        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (flat[1:] >> shift != flat[:-1] >> shift)])
                        shards, who = flat[first] >> shift, owner[first]
                        lists = [flat[a:z].tobytes() for a, z in zip(first, np.r_[first[1:], len(flat)], strict=True)]
                    at = pa.array(rows[who])
                    yield pa.RecordBatch.from_arrays([pa.array(_key(dims, t, shards)), pa.array(lists, pa.binary()), b["qno"].take(at), b["v"].take(at)], ["key", "codes", "qno", "v"])

    return run


def _met(kind: type, want: int):
    """Pieces come as runs: their classes in the order of codes, then the queries, which read the classes under their codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, filed, shelf = None, [], None
        for b in batches:
            key, piece, side = (np.asarray(b[c]) for c in ("key", "piece", "side"))
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]) | (side[1:] != side[:-1])])
            for a, z in zip(edges, np.r_[edges[1:], len(key)], strict=True):
                part = b.slice(a, z - a)
                if (key[a], piece[a]) != group:
                    group, filed, shelf = (key[a], piece[a]), [], None
                if side[a] == 0:
                    filed.append(part.select(["code", "ids", "v"]))
                    continue
                if not filed:
                    continue
                if shelf is None:
                    t = pa.Table.from_batches(filed).combine_chunks()
                    x, norm = next(_all(t["v"].chunk(0), kind))
                    shelf = np.asarray(t["code"]), t["ids"].to_pylist(), x, norm
                yield from _answers(part, shelf, kind, want)

    return run


def _all(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All vectors of a piece, which has one length."""
    parts = [(x, norm) for _, _, x, norm in _matrices(column, kind)]
    yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _answers(part: pa.RecordBatch, shelf: tuple, kind: type, want: int) -> Iterator[pa.RecordBatch]:
    code, ids, x, norm = shelf
    smallest, out = np.array([i[0] for i in ids]), ([], [], [])
    for at in range(0, part.num_rows, _CHUNK):
        rows = part.slice(at, _CHUNK)
        q, q_norm = next(_all(rows["v"], kind))
        for j, (qno, probed) in enumerate(zip(rows["qno"].to_pylist(), rows["codes"].to_pylist(), strict=True)):
            if probed:
                wanted = np.frombuffer(probed, np.int64)
                lo, hi = np.searchsorted(code, wanted, "left"), np.searchsorted(code, wanted, "right")
                near = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi, strict=True) if z > a] or [np.empty(0, np.int64)])
            else:
                near = np.arange(len(code))
            scores = np.einsum("ij,j->i", x[near], q[j]) / (norm[near] * q_norm[j])
            for i in best_classes(scores, smallest[near], want):
                members = ids[near[i]]
                out[0].extend([qno] * len(members))
                out[1].extend(members)
                out[2].extend([scores[i]] * len(members))
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qno", "vec_id", "score"])


def _search(classes: DataFrame, asked: DataFrame, kind: type, want: int, bits: int, tables: int, count: int | None) -> DataFrame:
    """(qno, near): each query's ``want`` best (score, vec_id) among what it probes."""
    shift = max(0, bits - max(0, (max(1, classes.count()) // PIECE).bit_length()))
    filed = classes.mapInArrow(_filed(kind, bits, shift, tables), "key long, salt long, code long, ids array<long>, v binary")
    sizes = materialise(filed.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "sizes")
    pieces = F.ceil(F.col("times") / PIECE)
    null = lambda kind_: F.lit(None).cast(kind_)
    left = spread_join(filed, sizes, "key").select("key", F.pmod("salt", pieces).alias("piece"), F.lit(0).alias("side"), "code", null("binary").alias("codes"), null("long").alias("qno"), "ids", "v")
    met = spread_join(asked.mapInArrow(_asked(kind, bits, shift, tables, count), "key long, codes binary, qno long, v binary"), sizes, "key")
    met = met.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    right = met.select("key", "piece", F.lit(1).alias("side"), null("long").alias("code"), "codes", "qno", null("array<long>").alias("ids"), "v")
    both = left.unionByName(right).repartition("key", "piece").sortWithinPartitions("key", "piece", "side", "code")
    return listed(both.mapInArrow(_met(kind, want), "qno long, vec_id long, score double").groupBy("qno", "vec_id").agg(F.max("score").alias("score")), want)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, column: str = "embedding", probed: Callable[[int], int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``is_query``, by cosine, ties to the smaller id.

    ``vectors`` holds (vec_id, ``column``); ``is_query`` is an expression of vec_id. Null ids and vectors that are null, empty, zero or hold
    a null or non-finite component take no part; a query meets vectors of its own length only, and no row of its own id. A row repeated with
    the same vector counts once; an id with several vectors asks once, and is found once, for each of them. ``probed`` gives the number of
    codes that a query probes in a table of so many codes. Empty tables give an empty result.
    """
    rows, kind = usable(vectors, column)
    rows = materialise(rows, "vectors")

    def search(classes: DataFrame, asked: DataFrame, want: int) -> DataFrame:
        bits = max(1, (max(1, classes.count()) // FILL).bit_length())
        count = max(1, round(REACH * 2 ** (0.6 * bits))) if probed is None else probed(1 << bits)
        found = materialise(_search(classes, asked, kind, want, bits, TABLES, count), "near")
        full = found.where(F.size("near") >= want)
        few = asked.join(full.select("qno"), "qno", "left_anti")
        return found if few.isEmpty() else full.unionByName(_search(classes, few, kind, want, bits, 1, None))

    return answers(rows, is_query, k, search)
