import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.llm import vafile


def brute(x, ids, q, qi, k):
    s = sorted(((-int(sum(int(a) * int(b) for a, b in zip(v, q))), int(i)) for v, i in zip(x, ids) if i != qi))[:k]
    return [(i, -n) for n, i in s]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6), st.sampled_from([2, 300, 2**40]))
def test_bounds_hold_and_reading_in_their_order_is_exact(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread, (n, dims)).astype(float)
    ids, q = rng.permutation(n).astype(np.int64), np.floor(rng.normal(size=(3, dims)) * min(spread, 2**20))
    lower, upper = vafile.bounds(*vafile.cells_of(x, 3), q)
    for j in range(3):
        exact = [sum(int(a) * int(b) for a, b in zip(v, q[j])) for v in x]
        assert all(lo <= e <= hi for lo, e, hi in zip(lower[j], exact, upper[j])) or spread > 2**30
        if spread <= 2**30:
            floor = np.sort(lower[j])[-5:].min() if n >= 5 else -np.inf
            named = np.flatnonzero(upper[j] >= floor)
            named = named[np.argsort(-upper[j][named], kind="stable")]
            places, scores = vafile.read_in_order(x, q[j], named, upper[j][named], ids, 5, step=4)
            assert [(int(ids[p]), int(s)) for p, s in zip(places, scores)] == brute(x, ids, q[j], -1, 5)


def test_exact_vectors_are_read_for_few_cells_only(monkeypatch):
    """Over 20 blocks: floors come from all blocks, so few vectors of few blocks are named, and fewer read."""
    rng = np.random.default_rng(5)
    x, q, read = np.floor(rng.normal(size=(20, 100, 16)) * 256), np.floor(rng.normal(size=(3, 16)) * 256), []
    exact = vafile._exact
    monkeypatch.setattr(vafile, "_exact", lambda rows, v: read.append(len(rows)) or exact(rows, v))
    met = [vafile.bounds(*vafile.cells_of(b, 6), q) for b in x]
    for j in range(3):
        floor, best = np.sort(np.concatenate([lower[j] for lower, _ in met]))[-5], []
        for n, (_, upper) in enumerate(met):
            named = np.flatnonzero(upper[j] >= floor)
            named = named[np.argsort(-upper[j][named], kind="stable")]
            places, scores = vafile.read_in_order(x[n], q[j], named, upper[j][named], np.arange(100), 5)
            best += [(n * 100 + int(p), int(s)) for p, s in zip(places, scores)]
        assert sorted(best, key=lambda p: (-p[1], p[0]))[:5] == brute(x.reshape(-1, 16), range(2000), q[j], -1, 5)
    assert sum(read) < 0.02 * 3 * 2000


def test_whole_query(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 64)
    monkeypatch.setattr(vafile, "PART", 128)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(300)] + [(300, None, 0), (350, [1.0, float("nan")] + [0.0] * 6, 0), (400, [1.0] * 7 + [None], 0), (450, [], 0), (500, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    v = vafile.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {}
    for r in vafile.top_k(v, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(256 * np.float64(np.array(e, np.float32)))) for i, e, _ in rows[:300]]
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for qi, found in got.items():
        assert [(b, c) for _, b, c in sorted(found)] == brute([e for _, e in good], [i for i, _ in good], good[qi][1], qi, 5)


def test_repeated_rows_and_huge_components(spark):
    rows = [(50, [1.0, 2.0])] * 3 + [(i, [float(i), 1.0]) for i in range(1, 5)] + [(7, [3e18, 1.0]), (100, [1e3, 0.0, 1.0])]
    v = vafile.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.v for r in v.collect()}[7] == [3e18 * 256, 256.0]
    got = [(r.query_id, r["rank"], r.vec_id) for r in vafile.top_k(v.where("vec_id <> 7"), F.col("vec_id") % 50 == 0, k=2).collect()]
    assert sorted(got) == [(50, 1, 4), (50, 2, 3)]  # a query that occurs three times asks once, as it is one row


def test_repeated_ids_are_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.integers(-3, 4, 3)]) for i in rng.integers(0, 40, 300)] + [(50, [1.0, 1.0, 1.0])] * 20 + [(i, [2.0, 2.0, 2.0]) for i in range(60, 100)]
    v = vafile.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(v, F.col("vec_id") % 10 == 0).collect())
    distinct = sorted({(i, tuple(256 * np.array(e))) for i, e in rows})
    want = sorted((qi, n, i, s) for qi, q in distinct if qi % 10 == 0 for n, (i, s) in enumerate(brute([np.array(e) for _, e in distinct], [i for i, _ in distinct], np.array(q), qi, 5), 1))
    assert got == want


def test_nothing_to_search(spark):
    v = vafile.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert vafile.top_k(v, F.lit(True)).count() == 0
    one = vafile.quantised(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>"))
    assert vafile.top_k(one, F.lit(True)).count() == 0
