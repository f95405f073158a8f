"""Language identification by hierarchical discrimination.

A linear machine first chooses the language family, then one-versus-one linear support vector
machines separate the languages within it. Features are relative frequencies of hashed byte
trigrams over the whole text, so a text is one pass of table look-ups whatever its length.
Training takes at most ``sample`` documents, drawn by a hash of their id and text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .linear import squared_hinge_svm

SAMPLE, DIMS = 2000, 2048
UNDETERMINED = "und"
#: Language families. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def slots(text: bytes) -> np.ndarray:
    """Hashed trigram numbers of a text: A-Z folded, every other ASCII byte a blank."""
    b = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)


def features(text: bytes) -> np.ndarray:
    return np.sqrt(np.bincount(slots(text), minlength=DIMS) / max(1, len(text) + 0.0)).astype(np.float32)


class Hierarchy:
    """Family machines and, within each family, one machine per pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        y = np.array(langs)
        self.family = {lang: _FAMILY.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        fam = np.array([self.family[lang] for lang in langs])
        # of two families one machine tells both: the other is its mirror image
        self.top = [squared_hinge_svm(x, np.where(fam == f, 1, -1)) for f in (self.families if len(self.families) > 2 else self.families[1:])]
        if len(self.top) == 1:
            self.top.insert(0, (-self.top[0][0], -self.top[0][1]))
        self.pairs = {}
        for f in self.families:
            for a, b in combinations([lang for lang in self.langs if self.family[lang] == f], 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = squared_hinge_svm(x[rows], np.where(y[rows] == a, 1, -1))

    def predict(self, text: bytes) -> tuple[str, float]:
        """(language, score): the score is the product of the chosen family's and language's odds."""
        x = features(text)
        score = 1.0
        if self.top:
            margins = np.array([float(x @ w) + c for w, c in self.top])
            best = int(np.argmax(margins))
            others = np.delete(margins, best)
            score, family = _odds(margins[best] - others.max()), self.families[best]
        else:
            family = self.families[0]
        members = [lang for lang in self.langs if self.family[lang] == family]
        votes, least = dict.fromkeys(members, 0), dict.fromkeys(members, 1.0)
        for (a, b), (w, c) in self.pairs.items():
            if self.family[a] == family:
                m = float(x @ w) + c
                winner = a if m >= 0 else b
                votes[winner] += 1
                least[winner] = min(least[winner], _odds(2 * abs(m)))
        lang = max(members, key=lambda m: (votes[m], least[m]))
        return lang, score * least[lang]


def _odds(margin: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, 2 * margin))))


def _draw(docs: DataFrame, sample: int) -> tuple[np.ndarray, list[str]]:
    """Features and languages of at most ``sample`` labelled documents, few of a language spared.

    Each language gets an equal part of the sample: its rows of the lowest hashes of id and text.
    So the draw hangs on the rows alone, not on their order or files.
    """
    known = docs.where(F.col("lang").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return np.empty((0, DIMS), np.float32), []
    each = max(1, sample // len(sizes))
    enough = each + 6 * each**0.5 + 6  # so many are expected under the bound below; it is exceeded by far less than one draw in a million
    pick = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(min(1.0, enough / n) * (1 << 40)))])
    drawn = known.where(pick < F.element_at(share, F.col("lang"))).select("lang", pick.alias("pick"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            x = [features(t).tobytes() for t in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["lang"], b["pick"], pa.array(x, pa.binary())], ["lang", "pick", "x"])

    got = drawn.mapInArrow(run, "lang string, pick long, x binary").toArrow()
    found = sorted(zip(got["lang"].to_pylist(), got["pick"].to_pylist(), got["x"].to_pylist(), strict=True))
    kept = [r for i, r in enumerate(found) if i < each or found[i - each][0] != r[0]]
    x, langs = np.array([np.frombuffer(r[2], np.float32) for r in kept]).reshape(-1, DIMS), [r[0] for r in kept]
    del got, found, kept
    pa.default_memory_pool().release_unused()
    return x, langs


def train(docs: DataFrame, sample: int = SAMPLE) -> Hierarchy | None:
    """Learn from the rows of ``docs`` (text, lang) with a language and a letter; None if there are none."""
    x, langs = _draw(docs, sample)
    return Hierarchy(x, langs) if langs else None


def predictor(docs: DataFrame, model: Hierarchy | None):
    """A function from a text column to a struct (lang_pred, score).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if there
    was nothing to learn from.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        for t in texts:
            if m is None or t is None or not any(map(str.isalpha, t)):
                out.append((UNDETERMINED, 0.0))
            else:
                out.append(m.predict(t.encode()))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    def column(text: Column) -> Column:
        return predict(text.cast("string"))

    return column
