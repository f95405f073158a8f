"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier in numpy learns from confirmed toxic texts and from unlabelled ones. Its
risk is pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), pi being the class
prior: the estimated risk of the hidden negatives cannot go below zero, and where it would, the
step is reversed (Kiryo et al., 2017). pi is the share of toxic rows among the labels learned
from. Features are presence bits of words and of word beginnings, over whole texts.

Training reads at most ``sample`` positives and twice as many unlabelled texts: those of the lowest
hashes of their ids, whatever the order of the rows. An id with any toxic label counts as toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SAMPLE = 4000
_WORD = re.compile(r"\w+")
_STEMS = (4, 5)
_DRAW = 1 << 40


def features(text: str) -> set[int]:
    """Hashes of the distinct words of a text and of the beginnings of its longer words.

    A beginning shared by two or more, or by four or more, distinct words has features of its own.
    """
    words = set(_WORD.findall(text.lower()))
    found = {zlib.crc32(w.encode()) for w in words}
    for n in _STEMS:
        stems = Counter([w[:n] for w in words if len(w) > n])
        found |= {zlib.crc32(s.encode(), n) for s in stems}
        for s, k in stems.items():
            if k > 1:
                found.add(zlib.crc32(s.encode(), n + 16))
                if k > 3:
                    found.add(zlib.crc32(s.encode(), n + 32))
    return found


class Classifier:
    """Weights of the features kept, an offset, and how a score comes of them."""

    def __init__(self, weights: dict[int, float], offset: float) -> None:
        self.weights, self.offset = weights, offset

    def score(self, text: str) -> float:
        f = self.offset + sum(map(self.weights.__getitem__, self.weights.keys() & features(text)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, f)))))


def risk_step(w: np.ndarray, b: float, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, np.ndarray, float]:
    """(estimated risk of the hidden negatives, gradient for the weights, gradient for the offset).

    Each side is (text numbers, feature numbers, number of texts). The gradient is that of the whole
    risk while the hidden part is zero or more, else that of the hidden part reversed.
    """
    (pr, pf, n_p), (ur, uf, n_u) = positive, unlabelled
    zp, zu = b + np.bincount(pr, w[pf], n_p), b + np.bincount(ur, w[uf], n_u)
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    hidden = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    gu, gp = su / n_u, -prior * sp / n_p
    gp, gu = (gp + prior * (sp - 1) / n_p, gu) if hidden >= 0 else (-gp, -gu)
    return hidden, np.bincount(pf, gp[pr], len(w)) + np.bincount(uf, gu[ur], len(w)), float(gp.sum() + gu.sum())


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 600, rate: float = 0.05,
         ridge: float = 2e-5, min_positive: int = 5, min_share: float = 0.02, purity: float = 0.5) -> Classifier:
    """Train on the feature hashes of positive and of unlabelled texts.

    Kept are the features found in ``min_positive`` positives and in the share ``min_share`` of
    them, at least, if by the class prior ``purity`` or more of all texts that hold them are
    positive.
    """
    prior = min(max(prior, 1e-4), 0.9)
    if not positive:
        return Classifier({}, float(np.log(prior / (1 - prior))))
    enough = max(min_positive, min_share * len(positive))
    p_all, p_n = np.unique(np.concatenate(positive), return_counts=True)
    p_all, p_n = p_all[p_n >= enough], p_n[p_n >= enough]
    (pr, pf), (ur, uf), n_p, n_u = _present(positive, p_all), _present(unlabelled, p_all), len(positive), max(1, len(unlabelled))
    pure = (p_n / n_p) / ((np.bincount(uf, minlength=len(p_all)) + 0.5) / (len(unlabelled) + 1))
    order = np.argsort(-pure, kind="stable")
    for k in [1 << i for i in range(len(order).bit_length())]:
        # of any set, P(set) >= pi * P(set | positive): the labels' share may be too high for the corpus
        top = np.zeros(len(p_all), bool)
        top[order[:k]] = True
        shown_p, shown_u = len(np.unique(pr[top[pf]])) / n_p, (len(np.unique(ur[top[uf]])) + 1) / n_u
        sure_u, sure_p = shown_u + 2 * np.sqrt(shown_u / n_u), shown_p - 2 * np.sqrt(shown_p / n_p)
        if sure_p >= 0.3:
            prior = min(prior, sure_u / sure_p)
    kept = np.flatnonzero(prior * pure >= purity)
    keep = p_all[kept]
    if not len(keep):
        return Classifier({}, float(np.log(prior / (1 - prior))))
    place = np.full(len(p_all), -1)
    place[kept] = np.arange(len(kept))
    (pr, pf), (ur, uf) = (((r[place[f] >= 0], place[f][place[f] >= 0])) for r, f in ((pr, pf), (ur, uf)))
    w, b = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, grad, gb = risk_step(w, b, (pr, pf, n_p), (ur, uf, n_u), prior)
        grad = grad + ridge * w
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        scale = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - scale * m / (np.sqrt(v) + 1e-10), b - scale * mb / (np.sqrt(vb) + 1e-10)
    return Classifier(dict(zip(keep.tolist(), w.tolist(), strict=True)), b)


def _present(texts: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of the sorted features present in each text."""
    r, f = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, t in enumerate(texts if len(features) else []):
        j = np.searchsorted(features, t)
        j = j[(j < len(features)) & (features[np.minimum(j, len(features) - 1)] == t)]
        r.append(np.full(len(j), i))
        f.append(j)
    return np.concatenate(r), np.concatenate(f)


def _hashes(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            x = [np.sort(np.fromiter(features(t or ""), np.int64).astype(np.uint32)).tobytes() for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["pick"], pa.array(x, pa.binary())], ["pick", "x"])


def _collect(texts: DataFrame, most: int) -> list[np.ndarray]:
    """The features of the ``most`` rows of the lowest hashes among those drawn, whatever their order; repeated rows count once.

    The rows are cut where they lie, so an id with any number of rows brings no more than ``most`` to the driver.
    """
    read = texts.select(_pick("doc_id").alias("pick"), F.col("text").cast("string").alias("text")).mapInArrow(_hashes, "pick long, x binary")
    got = read.distinct().orderBy("pick", "x").limit(most).toArrow()
    found = [np.frombuffer(x, np.uint32) for x in got["x"].to_pylist()]
    del got
    pa.default_memory_pool().release_unused()
    return found


def train(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> Classifier:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``learn`` maps an id column to the condition that its label may be learned. The ids of the
    drawn positives, at most ``sample``, are what is broadcast to find their texts. Null labels
    are unlabelled. Without positives every score is the class prior, one half at most.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n_labels, n_toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_docs = docs.select("doc_id").distinct().count()  # drawn by id: repeated rows must not change the draw
    drawn = usable.where(F.col("toxic") == 1).where(_draw("doc_id", sample, n_toxic)).select("doc_id")
    positive = _collect(docs.join(F.broadcast(drawn), "doc_id", "left_semi"), sample)
    unlabelled = _collect(docs.where(learn(F.col("doc_id"))).where(_draw("doc_id", 2 * sample, n_docs)), 2 * sample)
    return nnpu(positive, unlabelled, n_toxic / n_labels if n_labels else 0.1)


def _draw(column: str, wanted: int, there: int) -> Column:
    """A hash draw of about ``wanted`` of ``there`` rows, all if there are no more."""
    share = int(min(1.0, (wanted + 6 * wanted**0.5) / max(1, there)) * _DRAW)
    return _pick(column) < share


def _pick(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(11)), F.lit(_DRAW))


def scorer(docs: DataFrame, model: Classifier):
    """A function from a text column to the score; a null text scores as the empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(t or "") for t in texts], dtype=float)

    def column(text: Column) -> Column:
        return score(text.cast("string"))

    return column
