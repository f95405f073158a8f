"""Ranked search against plain Python, and the bisection against its definition."""

import math
import random
import re

import numpy as np
import pytest

from assayline.llm import bisected_search as bs

TERM = re.compile(bs.PATTERN)


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    """[(item, rank, doc_id, score)] sorted; documents are (doc_id, text)."""
    read = [(i, t) for i, t in ((i, terms_of(x)) for i, x in docs) if t]
    total, length, df = len(read), sum(len(t) for _, t in read), {}
    for _, t in read:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked, out = {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    for item, words in asked.items():
        found = []
        for i, t in read:
            m = 50 + 50 * len(t) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in words & set(t))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Al", "be", "gä", "日", "7") for b in "abcdefghij"]
    topics = [rng.sample(words, 12) for _ in range(6)]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(topics[i % 6]) for _ in range(rng.randint(0, 30)))) for i in range(n)]


ITEMS = "item_id long, text string, doc_id string, score int, rank int"


def frames(spark, docs, items):
    clash = "doc_id long, text string, term int, cluster int, n int, leaf string, qno long"
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in docs], clash).repartition(3), spark.createDataFrame([(i, t, "y", 1, 2) for i, t in items], ITEMS)


def test_search_is_brute_force(spark, monkeypatch):
    docs = corpus(400, 1)
    items = [(i, docs[i * 3][1]) for i in range(25)] + [(99, "nowhere to be found zz"), (98, ""), (97, None)]
    want = brute(docs, items, 10)
    for piece, size, first, pairs in ((2048, 256, 8, 1 << 18), (64, 5, 1, 40)):  # whole; many pieces, clusters, rounds and blocks
        monkeypatch.setattr(bs, "PIECE", piece)
        monkeypatch.setattr(bs, "FIRST", first)
        monkeypatch.setattr(bs, "GROWTH", 2)
        monkeypatch.setattr(bs, "PAIRS", pairs)
        index, total = bs.build(frames(spark, docs, items)[0], size)
        assert sum(len(r.ids) for r in index.select("ids").collect()) == total == sum(1 for _, t in docs if terms_of(t))
        assert rows_of(bs.search(index, total, frames(spark, docs, items)[1], 10)) == want


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    docs = [(r[0], r[1]) for r in odd_rows]
    items = [(1, "the quick BROWN fox"), (1, "le chat"), (None, "no id here at all"), (2, None), (3, "word12 word13 THE 日本語"), (4, "again")]
    want = brute(docs, items)
    got = rows_of(bs.ranked(odd_docs, frames(spark, [], items)[1]))
    assert got == want and any(r[2] is None for r in got)
    assert bs.ranked(no_docs, frames(spark, [], items)[1]).count() == 0
    assert bs.ranked(odd_docs, frames(spark, [], [])[1]).count() == 0


def test_ties_of_many_copies_go_to_the_smallest_ids(spark):
    docs = [(i, "same words again") for i in range(300, 0, -1)] + [(1000, "other things"), (7, "same words again")]
    items = [(1, "words")]
    got = rows_of(bs.ranked(*frames(spark, docs, items)))
    assert got == brute(docs, items) and sum(r[2] == 7 for r in got) == 2


def test_bisection_puts_like_documents_together():
    rng = np.random.default_rng(0)
    kinds = rng.permutation(np.repeat(np.arange(4), 16))
    rows = [np.unique(rng.integers(0, 20, 12)) + 20 * k for k in kinds]
    start, terms = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    found = bs.clusters(start, terms, 80, 16)
    assert sorted(np.concatenate(found).tolist()) == list(range(64)) and all(len(c) == 16 for c in found)
    assert sum(np.bincount(kinds[c]).max() for c in found) >= 60


def test_a_round_of_bisection_never_costs_more():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(41)]
    start, terms = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    owner = np.repeat(np.arange(41), np.diff(start))
    cost = lambda left: bs._cost(*(np.bincount(terms[side[owner]], minlength=30) for side in (left, ~left)), left.sum(), (~left).sum()).sum()
    left, a, b = bs.bisect(start, terms, 30)
    assert left.sum() == 21 and cost(left) <= cost(np.arange(41) < 21) + 1e-9
    assert (a == np.bincount(terms[left[owner]], minlength=30)).all() and (a + b == np.bincount(terms, minlength=30)).all()


@pytest.mark.parametrize("tf,n,total,length", [(1, 1, 1, 1), (7, 300, 1000, 250000), (10**6, 10**7, 10**11, 10**13)])
def test_impacts_are_whole_number_arithmetic(tf, n, total, length):
    m = 100 - 50 + (50 * n * total) // length
    assert bs.impacts(np.array([tf]), np.array([n]), total, length).tolist() == [10**9 * tf // (1000 * tf + 20 * m)]
