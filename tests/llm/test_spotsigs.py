import random
import re

import pyspark.sql.functions as F

from assayline.llm import spotsigs


def brute(text):
    """Signature strings of a text."""
    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    stop, out = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1:] if x not in stop][:spotsigs.CHAIN]
        if w in stop and len(chain) == spotsigs.CHAIN:
            out.add(tuple(chain))
    return out


def make(n, seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "la", "der"] + [f"word{i}" for i in range(40)]
    return [" ".join(rng.choices(vocab, k=rng.randrange(0, 80))) for _ in range(n)]


def test_signatures_equal_brute_force(spark):
    texts = make(60, 1) + ["", "The, of; AND -- word1 (word2) word3", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("text", F.size(spotsigs.signatures(F.col("text"))).alias("n")).collect():
        assert r.n == max(1, len(brute(r.text))), r.text


def test_fingerprints_and_likeness_equal_brute_force(spark):
    texts = [t for t in make(40, 5) if brute(t)] + ["the one two", "the one two three of one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    chains = {c for t in texts for c in brute(t)}
    for r in spotsigs.edited_comparison(df).collect():
        chains |= brute(r.edited)
    known = spark.createDataFrame([(" " + " ".join(c),) for c in chains], "s string").select("s", F.hash("s").alias("h")).collect()
    number = {tuple(r.s.split()): r.h for r in known}
    sets = [sorted(number[c] for c in brute(t)) for t in texts]
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for r in spotsigs.edited_comparison(df).collect():
        i, after = r.doc_id, (r.doc_id - 1) % len(texts)
        assert list(r.hashes) == sets[i] and abs(r.near_next - like(sets[i], sets[after])) < 1e-12
        if brute(r.edited):
            edited = sorted(number[c] for c in brute(r.edited))
            assert list(r.edited_hashes) == edited and abs(r.near_edited - like(sets[i], edited)) < 1e-12


def test_each_row_meets_the_next_by_descending_id(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**9), 200)
    rows = [(i, f"text of {i} the cat sat on the mat " * (i % 4)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, reverse=True)
    after = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    for buckets in (1, 7, 64):
        got = {r.doc_id: r.next_text for r in spotsigs.with_next(df, ["text"], buckets).collect()}
        assert got == after
    for r in spotsigs.edited_comparison(df).collect():
        text = dict(rows)[r.doc_id]
        half = len(text) // 2
        assert r.edited == text[:len(text) - half] + after[r.doc_id][:half] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_odd_rows(odd_docs, no_docs):
    got = spotsigs.edited_comparison(odd_docs).collect()
    assert len(got) == odd_docs.count()
    sets = {r.doc_id: r.hashes for r in got}
    assert sets[1] == sets[2] and sets[4] == sets[5] and all(sets.values())
    assert spotsigs.edited_comparison(no_docs).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for t in make(25, 8):
        w = t.split()
        texts.append(t)
        for _ in range(3):
            v = w[:]
            if v:
                v[rng.randrange(len(v))] = "word1"
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: frozenset(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    names = {}
    for i, s in sorted(sets.items()):
        names.setdefault(s, i)
    want = {(a, b): len(s & t) / len(s | t) for s, a in names.items() for t, b in names.items() if a < b and len(s & t) / len(s | t) >= 0.8}
    got = {(r.a, r.b): r.near for r in spotsigs.similar_pairs(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
