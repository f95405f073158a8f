"""The divergence audit against plain Python, and its parts against their definitions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from assayline.llm import divergence as dv
from assayline.llm.queries import ORACLE_SQL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FIELDS = ("lang", "source", "part", "item", "value", "rank")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, least=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        of = lambda n, all_, kept=kept: 1 + 10**9 * (n + 2) // (all_ + 2 * len(kept))
        whole = {t: of(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            mine = {t: of(counts[lang, s][t], total[s]) for t in kept}
            pairs = [(r, sum(f(mine[t], of(counts[lang, r][t], total[r])) for t in kept)) for r in sources if r != s]
            telling = [(t, f(mine[t], whole[t])) for t in kept if counts[lang, s][t] and mine[t] > whole[t]]
            for part, listed, most in (("pair", pairs, None), ("term", telling, 10)):
                ranked = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked, 1)}
    return out


def rows_of(df):
    return {tuple(r[c] for c in FIELDS) for r in df.collect()}


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "naïve", "日本", "x", "don't", "ÉCOLE", "gamma9delta", "été", "a" * 31, "B" * 32, "c" * 75]
    text = lambda: rng.choice([None, "", "12 34"]) if rng.random() < 0.1 else "".join(rng.choice(words) + rng.choice([" ", "\n", "-", "_", "1", ""]) for _ in range(rng.randint(1, 40)))
    return [(text(), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "d"])) for _ in range(n)]


def test_hashes_are_xxh64_and_slices_are_grouped_by_their_bytes(monkeypatch):
    rng = np.random.default_rng(0)
    for size in range(1, 70):
        rows = rng.integers(0, 256, (5, size)).astype(np.uint8)
        assert dv.hashes(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]
    low = np.frombuffer(b"abcabdabcabx", np.uint8)
    begin = np.arange(0, 12, 3)
    number, terms = dv.grouped(low, begin, begin + 3)
    assert [terms[i] for i in number] == [b"abc", b"abd", b"abc", b"abx"]
    monkeypatch.setattr(dv, "hashes", lambda rows: np.zeros(len(rows), np.uint64))  # every two slices collide
    number, terms = dv.grouped(low, begin, begin + 3)
    assert [terms[i] for i in number] == [b"abc", b"abd", b"abc", b"abx"] and len(terms) == 3


def test_boundaries_of_neighbouring_texts():
    texts = ["AbC d", "e", "", "f", "", "9"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begin, end = dv.boundaries(dv.LOOKUP[raw], np.r_[0, ends[:-1]], ends)
    assert [dv.LOOKUP[raw][a:z].tobytes() for a, z in zip(begin, end)] == [b"abc", b"d", b"e", b"f"]


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(dv, "RUN", 50)
    text = " ".join(w for r in corpus(40, 3) for w in [r[0] or "", "z" * 120]).encode()
    assert dv._long_text(np.frombuffer(text, np.uint8)) == Counter(t.encode() for t in terms_of(text.decode()))


def test_shares_are_exact_for_large_counts():
    n, total, kept = [0, 1, 10**12, 8 * 10**14], 8 * 10**14, 12345
    want = [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in n]
    assert dv.share(np.array(n), np.array([total] * 4), kept).tolist() == want
    assert dv.share(np.array([0]), np.array([0]), 1).tolist() == [10**9 + 1]


def test_audit_is_brute_force(spark, monkeypatch):
    rows = corpus(400, 1)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    want = brute(rows)
    assert rows_of(dv.audit(df)) == want and any(r[2] == "term" for r in want)
    monkeypatch.setattr(dv, "BLOCK", 3)  # many blocks of a language
    assert rows_of(dv.audit(df)) == want


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert rows_of(dv.audit(odd_docs)) == brute([(r[1], r[2], r[3]) for r in odd_rows])
    assert rows_of(dv.audit(odd_docs, least_docs=1)) == brute([(r[1], r[2], r[3]) for r in odd_rows], least=1)
    assert dv.audit(no_docs).count() == 0


def test_sql_gives_the_same_rows(spark):
    import duckdb

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()  # noqa: F841 - read by name
    want = duckdb.sql(ORACLE_SQL["op13_source_divergence"]).fetchall()
    assert rows_of(dv.audit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == set(want)
