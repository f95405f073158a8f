"""Cross-polytope hashing against brute force, and its parts against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import crosspolytope as cp

SCHEMA = "vec_id long, embedding array<float>, score string, v int, near string, times int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, e, "x", 1, "y", 2) for i, e in rows], schema)


def brute(rows, is_query, k=5):
    """{(query id, vector): [(vec_id, score)]} of the rows that take part, each once."""
    good = {(i, tuple(np.asarray(e, np.float32).tolist())) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    out = {}
    for i, e in good:
        if is_query(i):
            q = np.array(e, np.float64)
            near = [(j, float(np.dot(q, x) / np.sqrt(np.dot(q, q)) / np.sqrt(np.dot(x, x)))) for j, v in good if j != i and len(v) == len(e) for x in [np.array(v, np.float64)]]
            out[i, e] = sorted(near, key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


def got(df):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in df.collect()}


def test_rotation_keeps_lengths_and_the_first_probe_is_the_code():
    x = np.random.default_rng(1).normal(size=(50, 8))
    assert np.allclose(np.linalg.norm(cp.rotate(x, (8, 0, 0)), axis=1), np.linalg.norm(x, axis=1))
    unit = x[:, :5] / np.linalg.norm(x[:, :5], axis=1)[:, None]
    for bits in (1, 3, 4, 7, 11):
        c, p = cp.codes(unit, 5, 0, bits), cp.probes(unit, 5, 0, bits, 1 << bits)
        assert (p[:, 0] == c).all() and c.max() < 1 << bits
        assert all(len(set(r)) == len(r) for r in p.tolist())
    assert cp.widths(64, 11) == [64, 8] and cp.widths(64, 8) == [64, 1] and cp.widths(64, 7) == [64] and cp.widths(1, 1) == [1]


def test_all_codes_probed_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cp, "PIECE", 16)  # many shards and pieces
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    found = got(cp.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, probed=lambda codes: codes))
    want = {(q, r): p for (q, _), near in brute(rows, lambda i: i % 10 == 0).items() for r, p in enumerate(near, 1)}
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    found = got(cp.nearest(e, F.col("vec_id") % 50 == 0))
    want = [(q, near) for (q, _), near in brute(rows, lambda i: i % 50 == 0).items()]
    hits = sum(len({found[q, r][0] for r in range(1, 6)} & {j for j, _ in near}) for q, near in want)
    assert hits >= 0.9 * sum(len(near) for _, near in want)


def test_odd_rows(spark):
    """Null, empty, zero and non-finite vectors, other lengths, huge groups of copies, repeated rows and ids, fewer rows than asked for."""
    one = [1.0, 0.0, 0.5]
    rows = [(None, one), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (100, [1.0, 2.0]), (7, [2.0, 1.0])]
    rows += [(i, one) for i in range(10, 200) if i != 100] + [(50, one)] * 30 + [(150, [0.0, 1.0, 0.0]), (8, [0.0, 3.0, 0.1])]
    found = cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(by_query[50]) == [(1, 10), (2, 11), (3, 12), (4, 13), (5, 14)]
    assert by_query[100] == [(1, 7)]  # no other row has two components
    # an id with two vectors asks once with each of them and never meets itself
    assert sorted(by_query[150]) == sorted([(1, 10), (2, 11), (3, 12), (4, 13), (5, 14), (1, 8), (2, 10), (3, 11), (4, 12), (5, 13)])
    assert set(by_query) == {50, 100, 150}
    assert cp.nearest(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert cp.nearest(frame(spark, [(0, one)]), F.col("vec_id") % 50 == 0).count() == 0


def test_doubles_of_any_size(spark):
    rows = [(0, [1e300, 1e300], "", 1, "", 1), (1, [1e-300, 1e-300], "", 1, "", 1), (2, [1e300, -1e300], "", 1, "", 1)]
    found = got(cp.nearest(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), F.col("vec_id") == 0))
    assert found[0, 1] == (1, pytest.approx(1.0)) and found[0, 2] == (2, pytest.approx(0.0))
