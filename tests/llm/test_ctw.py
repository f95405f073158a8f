import math
import random
import zlib
from collections import Counter

import numpy as np

from assayline.llm import ctw
from assayline.llm.common import id_remainder


def reference(train, text, depth):
    """The same mixture by plain recursion over dictionaries."""
    counts = {}
    for t in train:
        s = [255] * depth + [*t] + [255]
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                ctx = tuple(s[i - d:i])[::-1]
                for k in range(8):
                    node = (1 << k) | (s[i] >> (8 - k))
                    counts.setdefault((ctx, node), [0, 0])[s[i] >> (7 - k) & 1] += 1
    children = {}
    for ctx, node in counts:
        if ctx:
            children.setdefault((ctx[:-1], node), set()).add(ctx)

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    def weighted(ctx, node):
        own = kt(counts[ctx, node])
        if len(ctx) == depth:
            return own, own
        below = sum(weighted(c, node)[1] for c in children.get((ctx, node), ()))
        return own, np.logaddexp(own, below) + math.log(0.5)

    def predict(ctx, node, d=0):
        here = ctx[:d]
        n = counts.get((here, node), [0, 0])
        own = (n[1] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        if (here, node) not in counts:
            return 0.5
        e, w = weighted(here, node)
        a = math.exp(e + math.log(0.5) - w)
        return a * own + (1 - a) * predict(ctx, node, d + 1)

    s, total = [255] * depth + [*text] + [255], 0.0
    for i in range(depth, len(s)):
        ctx = tuple(s[i - depth:i])[::-1]
        for k in range(8):
            node = (1 << k) | (s[i] >> (8 - k))
            p = predict(ctx, node)
            total += math.log10(p if s[i] >> (7 - k) & 1 else 1 - p)
    return total


def levels(train, depth):
    out = []
    for d in range(depth + 1):
        c = Counter()
        for t in train:
            s = [255] * depth + [*t] + [255]
            for i in range(depth, len(s)):
                code = 0
                for j in range(1, d + 1):
                    code = code << 8 | s[i - j]
                c[code, s[i]] += 1
        codes = np.array(sorted({k for k, _ in c}), np.int64)
        table = np.zeros((len(codes), 256))
        for (k, sym), n in c.items():
            table[np.searchsorted(codes, k), sym] = n
        out.append((codes, table))
    return out


def test_mixture_equals_plain_recursion():
    train = [b"abracadabra", b"abra", b"", b"cad\xc3\xa9"]
    for depth in (0, 1, 2, 3):
        m = ctw.Mixture(levels(train, depth))
        for text in (b"abra", b"", b"zq", b"cadabra\xc3\xa9"):
            assert math.isclose(m.log10([b"x", text, b""])[1], reference(train, text, depth), rel_tol=1e-4), (depth, text)


def test_probabilities_of_a_context_sum_to_one():
    m = ctw.Mixture(levels([b"hello world", b"hello"], 2))
    assert np.allclose((10.0 ** m.table).sum(axis=1), 1, atol=1e-4)
    assert math.isclose(ctw.Mixture([]).log10([b"ab"])[0], 3 * math.log10(1 / 256), rel_tol=1e-5)


def test_scores_and_base(spark, odd_docs, odd_rows, no_docs):
    out = id_remainder(odd_docs["doc_id"], 7) == 2
    got = [r.asDict() for r in ctw.score(odd_docs, ~out).collect()]
    assert len(got) == len(odd_rows)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t, *_ in odd_rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)) for i, t, *_ in odd_rows}
    for r in got:
        text = next(t for i, t, *_ in odd_rows if i == r["doc_id"])
        assert r["train_tokens"] == n and r["n_tokens"] == len(tokens(text)) and r["n_known"] == sum(c[w] > 0 for w in tokens(text))
        assert math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9) and r["score"] < 0 and r["bits_per_byte"] > 0
    assert ctw.score(no_docs, id_remainder(no_docs["doc_id"], 7) != 2).count() == 0


def test_long_words_are_looked_up_like_others(spark, monkeypatch):
    long = "boilerplate" * 30
    rows = [(i, f"{long} w{i % 3} {long.upper()}") for i in range(20)] + [(20, long + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = lambda t: t.lower().split() + [""]
    c = Counter(w for i, t in rows if i < 18 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for most in (1 << 16, 1):
        monkeypatch.setattr(ctw, "MAX_WORDS", most)
        for r in ctw.score(df, df["doc_id"] < 18).collect():
            text = tokens(rows[r.doc_id][1])
            assert r.n_tokens == len(text) and r.n_known == sum(c[w] > 0 for w in text)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in text), rel_tol=1e-9)


def test_no_context_is_cut_whatever_is_looked_up(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcdefgh é", k=rng.randrange(200)))) for i in range(40)] + [(40, None), (41, "zzz"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth, most in ((5, 50), (5, 1 << 21), (2, 20), (1, 20), (0, 3)):
        whole = ctw.Mixture(levels([(t or "").encode() for i, t in rows if i < 30], depth))
        want = sorted(zip([i for i, _ in rows], whole.log10([(t or "").encode() for _, t in rows]), strict=True))
        got = sorted((r.doc_id, r.score) for r in ctw.score(df, df["doc_id"] < 30, depth=depth, most=most).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4), (depth, most)
