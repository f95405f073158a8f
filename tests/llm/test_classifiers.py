import random

import numpy as np
import pyspark.sql.functions as F

from assayline.llm import langid, toxicity
from assayline.llm.common import id_remainder, table

SF = "/root/testdata/sf0.01"


def test_toxicity_finds_marked_words_and_leaves_the_rest(spark):
    rng = random.Random(0)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = rng.choices(plain, k=60)
        if bad:
            words[5], words[20] = rng.choice(["vileone", "viletwo"]), "nastyx" + rng.choice("abcdef") + "z"
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labs, lambda i: id_remainder(i, 5) != 0)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(docs, model)(F.col("text")).alias("s")).collect()}
    wrong = [i for i, s in got.items() if (s >= 0.5) != (i % 6 == 0)]
    assert len(wrong) <= 6 and all(0 <= s <= 1 for s in got.values())


def test_the_risk_never_goes_below_zero_for_long():
    pos = [np.array([1, 2]) for _ in range(30)]
    unl = [np.array([1, 2]) for _ in range(6)] + [np.array([9]) for _ in range(60)]
    m = toxicity.nnpu(pos, unl, 0.1, min_positive=5)
    s = lambda f: 1 / (1 + np.exp(-(m.offset + sum(m.weights.get(x, 0) for x in f))))
    assert s([1, 2]) > 0.5 > s([9])


def test_the_gradient_is_that_of_the_corrected_risk():
    rng = np.random.default_rng(3)
    xp, xu, w, b = rng.random((7, 4)) < 0.5, rng.random((11, 4)) < 0.4, rng.normal(size=4), 0.3
    sides = [(*np.nonzero(x), len(x)) for x in (xp, xu)]

    def risk(w, b, prior):
        loss = lambda z: np.log(1 + np.exp(-z))
        hidden = loss(-(xu @ w + b)).mean() - prior * loss(-(xp @ w + b)).mean()
        return hidden, prior * loss(xp @ w + b).mean() + hidden if hidden >= 0 else -hidden

    for prior in (0.2, 0.99):
        for shift in (0.0, 6.0):
            u, v = w + shift * (prior > 0.5) * np.array([1, -1, 1, -1]), b - shift
            hidden, grad, gb = toxicity.risk_step(u, v, *sides, prior)
            assert np.isclose(hidden, risk(u, v, prior)[0])
            e = 1e-6
            slope = [(risk(u + e * d, v, prior)[1] - risk(u - e * d, v, prior)[1]) / (2 * e) for d in np.eye(4)]
            assert np.allclose(grad, slope, atol=1e-6) and np.isclose(gb, (risk(u, v + e, prior)[1] - risk(u, v - e, prior)[1]) / (2 * e), atol=1e-6)
    far = np.full(4, 9.0)
    hidden, grad, _ = toxicity.risk_step(far, 5.0, sides[0], (np.array([0]), np.array([0]), 11), 0.99)
    assert hidden < 0 or grad.any()


def test_models_do_not_hang_on_the_order_of_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other, others = docs.repartition(7, "n_chars").orderBy(F.desc("n_chars")), labels.union(labels).repartition(3)
    known = lambda d: d.where(id_remainder(F.col("doc_id"), 3) != 1)
    a, b = langid.train(known(docs), 200), langid.train(known(other), 200)
    assert a.langs == b.langs and all(np.allclose(a.pairs[k][0], b.pairs[k][0], atol=1e-5) for k in a.pairs)
    a, b = (toxicity.train(d, x, lambda i: id_remainder(i, 5) != 0, sample=30) for d, x in ((docs, labels), (other, others)))
    assert a.weights.keys() == b.weights.keys() and all(np.isclose(a.weights[k], b.weights[k]) for k in a.weights)


def test_prediction_is_the_votes_within_the_best_family():
    rng = np.random.default_rng(4)
    texts = {lang: [" ".join(rng.choice([f"{lang}{i}{lang[::-1]}" for i in range(30)], 20)) for _ in range(8)] for lang in ("en", "de", "nl", "fr", "es")}
    x = np.array([langid.features(t.encode()) for ts in texts.values() for t in ts])
    h = langid.Hierarchy(x, [lang for lang, ts in texts.items() for _ in ts])
    for lang, ts in texts.items():
        for t in ts:
            f = langid.features(t.encode())
            family = h.families[int(np.argmax([f @ w + c for w, c in h.top]))]
            members = [m for m in h.langs if h.family[m] == family]
            wins = {m: sum((f @ h.pairs[p][0] + h.pairs[p][1] >= 0) == (p[0] == m) for p in h.pairs if m in p) for m in members}
            got, score = h.predict(t.encode())
            assert got in members and wins[got] == max(wins.values()) and got == lang and 0 <= score <= 1


def test_toxicity_without_examples(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, no_docs):
        m = toxicity.train(docs, labels, lambda i: id_remainder(i, 5) != 0)
        assert all(0 <= r.s < 0.5 for r in docs.select(toxicity.scorer(docs, m)(F.col("text")).alias("s")).collect())


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    model = langid.train(docs.where(id_remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    held = docs.where((id_remainder(F.col("doc_id"), 3) == 1) & F.col("lang").isNotNull())
    got = held.select("lang", langid.predictor(docs, model)(F.col("text")).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.p.score <= 1 for r in got)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r.p for r in odd_docs.select("doc_id", langid.predictor(odd_docs, model)(F.col("text")).alias("p")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 11))
    assert got[7].lang_pred == "fr" and got[1].lang_pred == "en"
    assert langid.train(no_docs) is None
    assert all(r.p.lang_pred == "und" for r in odd_docs.select(langid.predictor(odd_docs, None)(F.col("text")).alias("p")).collect())


def test_families_of_three_and_a_single_language():
    x = np.eye(6, langid.DIMS, dtype=np.float32).repeat(5, axis=0)
    langs = [lang for lang in ("en", "de", "fr", "es", "ru", "xx") for _ in range(5)]
    h = langid.Hierarchy(x, langs)
    assert len(h.families) == 4 and set(h.pairs) == {("de", "en"), ("es", "fr")}
    assert langid.Hierarchy(x[:5], ["en"] * 5).predict(b"hello")[0] == "en"


def test_a_row_repeated_many_times_leaves_the_toxicity_model_as_it_is(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    text = lambda bad: " ".join([*rng.choices(words, k=20), *(["nastyterm", "viletalk"] if bad else [])])
    rows = [(i, text(i % 10 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    model = lambda extra: toxicity.train(spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3), labels, lambda i: i >= 0, sample=60)
    once, often = model([]), model([rows[10]] * 10000)
    assert once.weights == often.weights and once.offset == often.offset and once.weights
