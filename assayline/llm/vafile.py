"""Exact top-k search through vector-approximation files.

The vectors are written once as a VA-file: blocks of at most ``BLOCK`` vectors of one length, each with the cell numbers of
all components on a grid of 2**bits cells per dimension, the grid, and, in columns that only the last pass reads, the exact
vectors. Three passes answer all queries:

1. every block's cells meet every block of queries and bound all inner products from both sides; a query's k-th largest
   lower bound, over all blocks, is its floor;
2. the cells again: vectors whose upper bound reaches the floor are named, block by block, in the order of their bounds;
3. only blocks with a named vector send their exact vectors, which are read in that order until the k-th exact score of the
   block proves that no unread one can enter the result.

The blocks of cells are dealt to parts and stay there; the blocks of queries, by the contract a fixed share of the rows, are
copied to every part. The plan has the same size however many queries there are, nothing is broadcast or brought to the
driver, and a task holds one block of each side at a time. Equal vectors are one class (``vector_classes``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vector_classes import answers, best_classes, listed

BLOCK, PART = 1024, 1 << 16
_FILE = "dims int, cells binary, low binary, width binary, exact binary, members array<array<long>>"


def quantised(df: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as doubles.

    Null vectors, vectors with a null or non-finite component and null ids are left out; empty
    vectors too, as they have no product with any query.
    """
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.where(v.isNotNull() & F.col("vec_id").isNotNull()).where((F.size(v) > 0) & ~bad)
    # floor() to a long would stop at 2**63; a double of that size is a whole number already
    floor = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: floor(x.cast("double") * scale)).alias("v"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, ends = np.asarray(b["v"].flatten(), np.float64), np.cumsum(np.asarray(b["v"].value_lengths()))
        parts = [flat[a:z].tobytes() for a, z in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends, strict=True)] if len(ends) else []
        yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(parts, pa.binary())], ["vec_id", "v"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[pa.RecordBatch]]]:
    """(dims, matrix, rows) of at most ``BLOCK`` vectors of one length, as many together as the batches allow."""
    held: dict[int, list[tuple[bytes, dict]]] = {}

    def made(dims: int, rows: list[dict]) -> tuple[int, np.ndarray, list[dict]]:
        return dims, np.frombuffer(b"".join(r["v"] for r in rows), np.float64).reshape(-1, dims), rows

    for b in batches:
        for row in b.to_pylist():
            dims = len(row["v"]) // 8
            rows = held.setdefault(dims, [])
            rows.append(row)
            if len(rows) == BLOCK:
                yield made(dims, held.pop(dims))
    for dims, rows in held.items():
        yield made(dims, rows)


def cells_of(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation: cell numbers (uint8), and the grid's origin and width per dimension."""
    low = x.min(axis=0)
    width = np.maximum(np.ceil((x.max(axis=0) - low + 1) / (1 << bits)), 1)
    return np.clip((x - low) // width, 0, (1 << bits) - 1).astype(np.uint8), low, width


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of all queries (rows) with all vectors (columns), from the cells alone."""
    mid = cells * width + (low + (width - 1) / 2)
    centre = q @ mid.T
    # half a cell either way, and what rounding of the sums can hide
    slack = np.abs(q) @ ((width + 1) / 2) + 1e-9 * (np.abs(q) @ np.abs(mid).max(axis=0, initial=0)) + 1e-6
    return centre - slack[:, None], centre + slack[:, None]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as int64. Doubles are exact below 2**53; larger products use whole numbers."""
    if x.size and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[-1] >= 2.0**53:
        return np.array([int(sum(int(a) * int(b) for a, b in zip(r, q, strict=True))) for r in x], dtype=np.int64)
    return (x @ q).astype(np.int64)


def read_in_order(x: np.ndarray, q: np.ndarray, places: np.ndarray, upper: np.ndarray, smallest: np.ndarray, want: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the best ``want`` named vectors of a block; ``places`` come by descending upper bound, and reading stops once it is certain."""
    best, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(places), step):
        if len(best) == want and upper[at] < scores[-1]:
            break
        part = places[at:at + step]
        best, scores = np.concatenate([best, part]), np.concatenate([scores, _exact(x[part], q)])
        keep = best_classes(scores, smallest[best], want)
        best, scores = best[keep], scores[keep]
    return best, scores


def _filed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, x, rows in _blocks(batches):
            parts = [np.ascontiguousarray(p).tobytes() for p in (*cells_of(x, bits), x)]
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *[pa.array([p], pa.binary()) for p in parts], pa.array([[r["ids"] for r in rows]], pa.list_(pa.list_(pa.int64())))], [f.split()[0] for f in _FILE.split(", ")])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dims, q, rows in _blocks(batches):
        floor = np.array([r["floor"] for r in rows], np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.array([r["qno"] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary()), pa.array([floor.tobytes()], pa.binary())], ["dims", "qnos", "q", "floors"])


def _met(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, queries, lower, upper) of one pair of blocks."""
    dims = b["dims"][r].as_py()
    of = lambda c, kind=np.float64: np.frombuffer(b[c][r].as_buffer(), kind)
    q = of("q").reshape(-1, dims)
    return of("qnos", np.int64), q, *bounds(of("cells", np.uint8).reshape(-1, dims), of("low"), of("width"), q)


def _floors(want: int):
    """Each query's ``want`` largest lower bounds over the blocks of a part that follow one another."""
    def emit(qnos: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        real = best > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qnos, best.shape[1])[real.ravel()]), pa.array(best[real])], ["qno", "lower"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = None, None
        for b in batches:
            for r in range(b.num_rows):
                qnos, _, lower, _ = _met(b, r)
                if held is not None and not np.array_equal(held, qnos):
                    yield emit(held, best)
                    held = None
                best = lower if held is None else np.concatenate([best, lower], axis=1)
                best, held = (np.partition(best, -want, axis=1)[:, -want:] if best.shape[1] > want else best), qnos.copy()
        if held is not None:
            yield emit(held, best)

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, qno, q, places, uppers): for each query the vectors of a block whose upper bound reaches its floor, best bound first."""
    for b in batches:
        for r in range(b.num_rows):
            qnos, q, _, upper = _met(b, r)
            floor, out = np.frombuffer(b["floors"][r].as_buffer(), np.float64), ([], [], [], [])
            reach = upper >= floor[:, None]
            for j in np.flatnonzero(reach.any(axis=1)).tolist():
                near = np.flatnonzero(reach[j])
                near = near[np.argsort(-upper[j, near], kind="stable")]
                for c, v in zip(out, (int(qnos[j]), q[j].tobytes(), near.astype(np.int32).tobytes(), upper[j, near].tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([b["block"][r].as_py()] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["block", "qno", "q", "places", "uppers"])


def _read(want: int):
    """Blocks come as their exact vectors, then the queries that name some of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, x, members, smallest = None, None, None, None
        for b in batches:
            out = ([], [], [])
            for r in range(b.num_rows):
                block = b["block"][r].as_py()
                if b["side"][r].as_py() == 0:
                    members = b["members"][r].as_py()
                    held, x = block, np.frombuffer(b["exact"][r].as_py(), np.float64).reshape(len(members), -1)
                    smallest = np.array([m[0] for m in members])
                    continue
                if block != held:
                    raise ValueError("a named block is missing")
                of = lambda c, kind, r=r, b=b: np.frombuffer(b[c][r].as_buffer(), kind)
                places, scores = read_in_order(x, of("q", np.float64), of("places", np.int32).astype(np.int64), of("uppers", np.float64), smallest, want)
                for p, s in zip(places.tolist(), scores.tolist(), strict=True):
                    for c, v in zip(out, ([b["qno"][r].as_py()] * len(members[p]), members[p], [s] * len(members[p])), strict=True):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["qno", "vec_id", "score"])

    return run


def _search(classes: DataFrame, asked: DataFrame, want: int, bits: int) -> DataFrame:
    """(qno, near) by the three passes."""
    file = materialise(classes.mapInArrow(_filed(bits), _FILE).withColumn("block", F.monotonically_increasing_id()), "vafile")
    parts = max(1, -(-(file.count() * BLOCK) // PART))
    cells = file.select("dims", "block", "cells", "low", "width").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))

    def meet(queries: DataFrame) -> DataFrame:
        blocks = materialise(queries.select("v", "qno", "floor").mapInArrow(_asked, "dims int, qnos binary, q binary, floors binary"), "asked")
        copied = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return copied.join(cells.hint("merge"), ["dims", "part"]).select("block", "dims", "qnos", "q", "floors", "cells", "low", "width")

    lower = meet(asked.withColumn("floor", F.lit(float("-inf")))).mapInArrow(_floors(want), "qno long, lower double")
    place = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("lower")))
    kth = lower.withColumn("place", place).where(F.col("place") == want).select("qno", F.col("lower").alias("floor"))
    floored = materialise(asked.join(kth, "qno", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    named = materialise(meet(floored).mapInArrow(_named, "block long, qno long, q binary, places binary, uppers binary"), "named")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    shelf = file.select("block", "exact", "members").join(named.select("block").distinct(), "block", "left_semi")
    both = shelf.select("block", F.lit(0).alias("side"), "exact", "members", null("qno", "long"), null("q", "binary"), null("places", "binary"), null("uppers", "binary")).unionByName(
        named.select("block", F.lit(1).alias("side"), null("exact", "binary"), null("members", "array<array<long>>"), "qno", "q", "places", "uppers"))
    found = both.repartition("block").sortWithinPartitions("block", "side").mapInArrow(_read(want), "qno long, vec_id long, score long")
    return listed(found, want)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows by integer inner product for every row that ``is_query``, ties to the smaller id.

    ``vectors`` holds (vec_id, v) as ``quantised`` makes them; ``is_query`` is an expression of vec_id. A query never meets rows of its own id, nor
    vectors of another length than its own. A row repeated with the same vector counts once; an id with several vectors asks once, and
    is found once, for each of them. Empty inputs give an empty result.
    """
    rows = materialise(vectors.mapInArrow(_packed, "vec_id long, v binary").distinct(), "vectors")
    return answers(rows, is_query, k, partial(_search, bits=bits))
