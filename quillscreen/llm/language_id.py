"""Language identification in two levels: family first, then one-versus-one linear SVMs inside the family.

Features are hashed byte n-grams (one to three bytes) of the lower-cased whole text, as square roots of counts scaled to
length one. Families are told apart by one linear SVM each against the rest; the languages of a family by one linear SVM per pair, with
votes and then margins deciding. Both are trained on the driver with dual coordinate descent from a bounded sample of the learnable
rows, about ``TRAIN_ROWS`` in all, spread evenly over the languages (the ``TRAIN_ROWS`` most frequent ones, if there are more) by a hash of id and text. The sample bounds the training
only: every document is predicted from its whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a language are never learned from; a
language not in FAMILIES is a family of its own; with nothing to learn from, all is ``und``; a null id counts as the empty id; every
row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue", "wuu"),
}
DIM, TRAIN_ROWS, EPOCHS, COST = 2048, 3000, 12, 10.0
LETTER = re.compile(r"[^\W\d_]")
UND = "und"


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text is 2 modulo 4 are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def featurise(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    one, two = b * np.uint32(2654435761), b[:-1] * np.uint32(2246822519) + b[1:] * np.uint32(3266489917)
    three = two[:-1] * np.uint32(31) + b[2:] * np.uint32(668265263) if len(b) > 2 else two[:0]
    x = sum(np.bincount(h >> np.uint32(21), minlength=DIM) for h in (one, two, three))
    x = np.sqrt(x).astype(np.float32)
    return x / max(np.linalg.norm(x), 1e-9)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def train_svm(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent; the last feature is constant and carries the bias. ``y`` is +1 or -1."""
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    soft = 0.5 / (COST * np.array([share[int(s)] for s in y]))
    norm = np.einsum("ij,ij->i", x, x) + soft
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Hierarchy:
    """The two levels of classifiers."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        x = with_bias(x)
        family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
        self.langs = sorted(set(lang))
        fam = np.array([family_of.get(v, v) for v in lang])
        self.families = sorted(set(fam))
        self.members = {f: sorted(set(lang[fam == f])) for f in self.families}
        several = len(self.families) > 1
        self.family_w = np.array([train_svm(x, np.where(fam == f, 1, -1)) for f in self.families]) if several else None
        self.pair_w = {}
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                rows = (lang == a) | (lang == b)
                self.pair_w[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores as the product of the logistic of the deciding margins."""
        if not self.langs:
            return [UND] * len(x), np.zeros(len(x))
        x = with_bias(x)
        sure = lambda m: 1 / (1 + np.exp(-4.0 * m))
        score = np.ones(len(x))
        which = np.zeros(len(x), int)
        if self.family_w is not None:
            margin = x @ self.family_w.T
            which = margin.argmax(1)
            score *= sure(margin.max(1))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            at, names = np.flatnonzero(which == k), self.members[f]
            votes, total = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            margins = {}
            for a, b in itertools.combinations(range(len(names)), 2):
                m = margins[a, b] = x[at] @ self.pair_w[names[a], names[b]]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                total[:, a] += np.tanh(m)
                total[:, b] -= np.tanh(m)
            best = (votes + total / (4 * len(names))).argmax(1)
            for a, b in margins:
                score[at] *= np.where(best == a, sure(margins[a, b]), np.where(best == b, sure(-margins[a, b]), 1.0))
            out[at] = np.array(names, object)[best]
        return out.tolist(), score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS) -> Hierarchy:
    """Train on at most about ``max_rows`` rows that are not held out and have a language and a letter."""
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    # A table of max_rows languages at most: each needs a row of the sample, so no more could be learned.
    counts = cut(usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows))
    each = max(1, max_rows // max(1, counts.count()))
    spread = F.pmod(F.xxhash64("i", "t"), F.lit(1_000_000)) / 1_000_000
    sample = usable.join(F.broadcast(counts), "lang").filter(spread < F.lit(each) / F.col("n")).select("lang", "i", "t")

    def features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            part = part[[bool(LETTER.search(t)) for t in part["t"]]]
            yield pd.DataFrame({"lang": part["lang"], "i": part["i"].astype("string"), "x": [featurise(t).astype(np.float16).tobytes() for t in part["t"]]})

    rows = sample.mapInPandas(features, "lang string, i string, x binary").limit(2 * max_rows).collect()
    rows.sort(key=lambda r: (r["lang"], r["i"] or "", bytes(r["x"])))
    x, lang = np.empty((len(rows), DIM), np.float32), np.array([r["lang"] for r in rows], object)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(bytes(r["x"]), np.float16)
    del rows
    return Hierarchy(x, lang)


def predict(docs: DataFrame, model: Hierarchy, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def say(texts: pd.Series) -> pd.DataFrame:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            got, s = model.predict(np.array([featurise(texts.iloc[i]) for i in part]))
            for i, v in zip(part, got, strict=True):
                lang[i] = v
            score[part] = s
        return pd.DataFrame({"lang_pred": lang, "score": score})

    said = docs.withColumn("__said", say(F.col(text_col)))
    return said.withColumns({"lang_pred": F.col("__said.lang_pred"), "score": F.col("__said.score")}).drop("__said")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their own columns.

    Every text with a letter is said to be of a learned language, so the rows that go are those with a null text or without a
    letter; text in a language that was never learned stays. So do all texts with a letter when nothing could be learned.
    """
    model = fit(docs, id_col, text_col, lang_col)
    if not model.langs:
        has_letter = F.pandas_udf(lambda texts: pd.Series([bool(t and LETTER.search(t)) for t in texts]), "boolean")
        return docs.filter(has_letter(F.col(text_col)))
    return predict(docs, model, text_col).filter(F.col("lang_pred") != UND).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
