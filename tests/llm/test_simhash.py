import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayline.llm import simhash


def brute(rows):
    """Components by comparing all pairs; fingerprints bit by bit."""
    prints = {}
    for i, text in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        sh = [" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints[i] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 2**64 - 1), st.integers(0, 5))
def test_bk_tree_finds_what_a_scan_finds(keys, probe, radius):
    near = keys + [k ^ (1 << i % 64) for i, k in enumerate(keys)] + [probe ^ 3]
    tree = simhash.BKTree()
    for k in near:
        tree.add(k)
    assert {tree.keys[i] for i in tree.near(probe, radius)} == {k for k in near if (k ^ probe).bit_count() <= radius}


def test_every_pair_within_the_radius_shares_a_shard():
    masks = [m & (2**64 - 1) for m in simhash._masks()]
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 2))
        assert any(a & m == b & m for m in masks)


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = []
    for t in texts:
        for _ in range(5):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) + 100, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  two")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_chains_are_followed_to_their_smallest_id(spark):
    chain = [(i, i + 1) for i in range(10, 60)] + [(5, 60), (100, 101)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.pop(n) for n in (100, 101) if n in got) <= {100}
    assert all(v == 5 for n, v in got.items() if n not in (100, 101))
    assert {*range(10, 61)} <= set(got)


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {4} and {r.doc_id for r in zero} >= {4, 5, 6}
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None in ids
    assert simhash.near_duplicates(no_docs).count() == 0


def test_deduplicate_finds_every_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 2)  # so that keys of three sets are cut into blocks
    rng = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(3000)]
    for _ in range(30):
        t = rng.choices(words, k=rng.randrange(4, 250))
        for edits in (0, 1, 2, 3):
            w = list(t)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    shared = rng.choices(words, k=60)
    rows += [(len(rows) + i, " ".join(shared + rng.choices(words, k=rng.choice([8, 9, 12, 15, 40])))) for i in range(25)]
    rows += [(0, "another text under an id that is taken"), (0, "another text under an id that is taken")]
    sets = [{" ".join(s) for s in zip(*(t.split()[i:] for i in range(5)))} or {t} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[i] for i in set(root))


def edited_copies(seed):
    """Texts with copies of a few edits each, and their five-word shingle sets."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(3000)]
    for _ in range(12):
        t = rng.choices(words, k=rng.randrange(60, 250))
        for edits in (0, 0, 1, 2, 3):
            w = list(t)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    shared = rng.choices(words, k=60)
    rows += [(len(rows) + i, " ".join(shared + rng.choices(words, k=rng.choice([8, 9, 12, 15, 40])))) for i in range(15)]
    return rows, [simhash.shingle_set(t.encode(), 5) for _, t in rows]


def alike(x, y):
    both = len(np.intersect1d(x, y))
    return both >= 0.8 * (len(x) + len(y) - both)


def test_a_shards_tree_finds_the_nearest_set_within_reach():
    _, sets = edited_copies(3)
    sets = sorted({s.tobytes(): s for s in sets}.values(), key=lambda s: s[0])
    fps = [simhash._majority(s.view(np.uint64)) for s in sets]
    sketches = [np.packbits(np.bincount(s & 2047, minlength=2048).astype(np.uint8) & 1).view(np.int64) for s in sets]
    shards = [i % 2 for i in range(len(sets))]
    order = sorted(range(len(sets)), key=lambda i: (shards[i], i))
    cols = [pa.array([shards[i] for i in order]), pa.array(order), pa.array([len(sets[i]) for i in order]), pa.array(np.array([fps[i] for i in order], np.uint64).view(np.int64)), pa.array([sketches[i] for i in order], pa.list_(pa.int64()))]
    rows = pa.RecordBatch.from_arrays(cols, ["shard", "node", "n", "fp", "sketch"])
    for reach in (0, 7, 16):
        got = {r["a"]: r["d"] for b in simhash._nearest(0.8, reach)([rows.slice(0, 20), rows.slice(20)]) for r in b.to_pylist()}
        expected = {}
        for i in range(len(sets)):
            for j in range(i % 2, i, 2):
                d, sizes = int(np.bitwise_count((sketches[i] ^ sketches[j]).view(np.uint64)).sum()), len(sets[i]) + len(sets[j])
                if (fps[i] ^ fps[j]).bit_count() <= reach and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and 1.8 * d <= 0.2 * sizes:
                    expected[i] = min(expected.get(i, 1.0), d / sizes)
        assert got == expected
    assert len(got) > 15


@pytest.mark.parametrize("reach", [-1, 16])
def test_components_come_from_the_trees_and_lose_nothing_beyond_their_reach(spark, monkeypatch, reach):
    """Sets meet in BK-trees of their fingerprints, whatever the reach leaves to the exact comparison."""
    rows, sets = edited_copies(5)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    seen, roots = [], simhash._roots
    monkeypatch.setattr(simhash, "REACH", reach)
    monkeypatch.setattr(simhash, "_SHARD", 3)
    monkeypatch.setattr(simhash, "_BLOCK", 4)
    monkeypatch.setattr(simhash, "_roots", lambda parents: seen.append(parents.count()) or roots(parents))
    got = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted([i for i in range(len(rows)) if root[i] == r] for r in set(root))
    joins = len({s.tobytes() for s in sets}) - len(set(root))
    assert seen == [0] if reach < 0 else 0 < seen[0] <= joins
    if reach == 16:
        assert seen[0] > 0.9 * joins
