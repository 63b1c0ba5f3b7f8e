"""Quality classifier by co-training two views of a document.

The text view sees counts taken from the content (symbols, letter case, word
variety, line lengths); the metadata view sees source, language and declared
length.  Each view has its own logistic regression.  Over a few rounds each
view labels the pool rows that it is surest of and hands them to the other;
then both are calibrated on held-out labelled rows and combined there.

A second target, toxic, is co-trained in the same way; its text view sees which
of the hashed words most bound to the label a text holds.  Without labels of
both kinds no row is found toxic.

The classifiers are fitted on at most ``LABELLED`` labelled and ``POOL``
unlabelled rows, those with the smallest hash of doc_id; every row is scored.

Defined cases: null text, source, language and length count as empty, empty,
empty and zero; rows with a null label are unlabelled; a doc_id with several
labels takes the smallest; without labels of both kinds every row gets the
labelled mean (1 without labels) from both views; repeated rows are scored
each, and of those that repeat a doc_id the one with the smallest hash is
fitted on; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import load, trim

#: Bounds of the sample that the classifiers are fitted on.
LABELLED, POOL = 6000, 6000
ROUNDS, SURE, HANDED = 4, 0.97, 0.05
KEEP = 0.5
BUCKETS = 64
SYMBOLS = b"|!%$#&*<>{}=_;:?.,-\"'()"
#: Word hashes, and how many of them the toxic target's text view takes.
WORD_BUCKETS, WORDS = 1 << 16, 64
COLUMNS = ("text", "source", "lang", "n_chars")


def text_features(text: str | None) -> np.ndarray:
    """Counts of one whole text, as shares, so that length alone says little."""
    raw = (text or "").encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    words = (text or "").split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = (text or "").split("\n")
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    return np.array(
        [
            *(np.log1p(50 * seen[list(SYMBOLS)] / n)),
            upper / max(1, upper + lower),
            np.log1p(20 * digits / size),
            seen[128:].sum() / size,
            np.log(max(1, len(set(words)))) / np.log(n + 1),
            min(20.0, len(raw) / n),
            np.log1p(n) / 10,
            np.log1p(n / len(lines)) / 5,
            len(set(lines)) / len(lines),
        ]
    )


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed one-hot source and language, and the declared length."""
    out = np.zeros(2 * BUCKETS + 1)
    out[xxhash.xxh32_intdigest(source or "") % BUCKETS] = 1
    out[BUCKETS + xxhash.xxh32_intdigest(lang or "") % BUCKETS] = 1
    out[-1] = np.log1p(max(0.0, float(n_chars or 0))) / 10
    return out


@dataclass
class Logistic:
    """Logistic regression with ridge, by Newton steps on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = sigmoid(z @ w)
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            w = w - np.linalg.solve(h, z.T @ (p - y) + penalty * w)
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class QualityModel:
    """Both views with their calibration, and the combination; without views the prior alone."""

    prior: float
    views: tuple[Logistic, Logistic] | None = None
    calibrated: tuple[Logistic, Logistic] | None = None
    combined: Logistic | None = None

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, combined) probabilities of good quality."""
        if self.views is None:
            flat = np.full(len(views[0]), self.prior)
            return flat, flat, flat
        logits = [c.logit(v.logit(x)[:, None]) for c, v, x in zip(self.calibrated, self.views, views, strict=True)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(self.combined.logit(np.column_stack(logits)))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, sure: float = SURE, handed: float = HANDED) -> QualityModel:
    """Fit both views; every fifth labelled row is held out for calibration and combination."""
    prior = float(y.mean()) if len(y) else 1.0
    held = np.arange(len(y)) % 5 == 0
    if any(len(set(y[m])) < 2 for m in (held, ~held)):
        return QualityModel(prior)
    xs, ys = [v[~held] for v in views], [y[~held], y[~held]]
    free = np.ones(len(pool[0]), bool)
    for _ in range(rounds):
        fits = [Logistic.fit(x, t) for x, t in zip(xs, ys, strict=True)]
        gains: list[tuple[np.ndarray, np.ndarray]] = []
        for view, fit in enumerate(fits):
            p = sigmoid(fit.logit(pool[view])) if len(pool[view]) else np.zeros(0)
            pick = []
            for label, q, share in ((1, p, prior), (0, 1 - p, 1 - prior)):
                at = np.flatnonzero(free & (q >= sure))
                at = at[np.argsort(-q[at], kind="stable")][: max(1, int(handed * share * len(p)))]
                pick += [(i, label) for i in at.tolist()]
            gains.append((np.array([i for i, _ in pick], int), np.array([t for _, t in pick], float)))
        for view, (at, labels) in enumerate(gains):
            other = 1 - view
            xs[other], ys[other] = np.concatenate([xs[other], pool[other][at]]), np.concatenate([ys[other], labels])
            free[at] = False
    fits = tuple(Logistic.fit(x, t) for x, t in zip(xs, ys, strict=True))
    raw = [f.logit(v[held])[:, None] for f, v in zip(fits, views, strict=True)]
    calibrated = tuple(Logistic.fit(r, y[held]) for r in raw)
    both = np.column_stack([c.logit(r) for c, r in zip(calibrated, raw, strict=True)])
    return QualityModel(prior, fits, calibrated, Logistic.fit(both, y[held]))


def _views(text, source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([text_features(t) for t in text]).reshape(len(text), len(text_features("")))
    z = np.array([meta_features(s, g, None if pd.isna(n) else n) for s, g, n in zip(source, lang, n_chars, strict=True)]).reshape(len(text), 2 * BUCKETS + 1)
    return x, z


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in COLUMNS[:3]), F.col("n_chars").cast("double").alias("n_chars"))


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> QualityModel:
    """Fit on the bounded sample; only its features come to the driver."""
    spark, own = docs.sparkSession, _columns(docs)
    mark = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("double")).alias("y"))
    first = mark.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    others = own.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled + pool).collect()
    y = {r.doc_id: float(r.y > 0) for r in first}
    ids = sorted(y) + sorted({r.doc_id for r in others} - set(y))[:pool]
    if not ids:
        return QualityModel(1.0)
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))  # labelled + pool rows at most

    @F.pandas_udf("struct<x array<double>, z array<double>>")
    def features(text: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        x, z = _views(text, source, lang, n)
        return pd.DataFrame({"x": list(x), "z": list(z)})

    rows = own.join(wanted, "doc_id", "left_semi").select("doc_id", F.xxhash64(*COLUMNS).alias("tag"), features(*COLUMNS).alias("f")).groupBy("doc_id").agg(F.min_by("f", "tag").alias("f")).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    known, rest = [r for r in rows if r.doc_id in y], [r for r in rows if r.doc_id not in y]
    width = {"x": len(text_features("")), "z": len(meta_features("", "", 0))}
    take = lambda some, k: np.array([r.f[k] for r in some]).reshape(len(some), width[k])
    return co_train((take(known, "x"), take(known, "z")), np.array([y[r.doc_id] for r in known]), (take(rest, "x"), take(rest, "z")))


def word_buckets(text: str | None) -> np.ndarray:
    """Hashes of the distinct lower-case words of one whole text."""
    return np.array(sorted({xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in set(re.findall(r"\w+", (text or "").lower()))}), np.uint16)


def _meta(source, lang, n_chars) -> np.ndarray:
    return np.array([meta_features(s, g, None if pd.isna(n) else n) for s, g, n in zip(source, lang, n_chars, strict=True)]).reshape(len(source), 2 * BUCKETS + 1)


@dataclass
class ToxicModel:
    """The words that the text view looks for, and both views; without a model nothing is toxic."""

    words: np.ndarray
    model: QualityModel | None = None

    def holds(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([np.isin(self.words, b) for b in found], float).reshape(len(found), len(self.words))

    def score(self, text: list, meta: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(text))
        return self.model.score((self.holds([word_buckets(t) for t in text]), meta))[2]


def telling_words(found: list[np.ndarray], y: np.ndarray, most: int = WORDS) -> np.ndarray:
    """The hashes that depend most on the label, by chi square; fewer of them where the rarer label has few rows."""
    most = max(1, min(most, int(min(y.sum(), len(y) - y.sum())) // 2))
    held = lambda k: np.bincount(np.concatenate([np.zeros(0, np.int64), *(b for b, t in zip(found, y, strict=True) if t == k)]).astype(np.int64), minlength=WORD_BUCKETS).astype(float)
    a, b, p, n = held(1.0), held(0.0), float(y.sum()), len(y)
    rows = a + b
    chi = n * (a * (n - p) - b * p) ** 2 / np.maximum(1.0, rows * (n - rows) * p * (n - p))
    return np.argsort(-chi, kind="stable")[:most].astype(np.uint16)


def fit_toxic(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> ToxicModel:
    """Fit the second target on a sample bounded like that of fit_quality."""
    none = ToxicModel(np.zeros(0, np.uint16))
    if "toxic" not in labels.columns:
        return none
    spark, own = docs.sparkSession, _columns(docs)
    mark = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("double")).alias("y"))
    y = {r.doc_id: float(r.y > 0) for r in mark.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
    if len(set(y.values())) < 2:
        return none
    others = own.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled + pool).collect()
    ids = sorted(y) + sorted({r.doc_id for r in others} - set(y))[:pool]
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))  # labelled + pool rows at most

    @F.pandas_udf("struct<x binary, z array<double>>")
    def features(text: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"x": [word_buckets(t).tobytes() for t in text], "z": list(_meta(source, lang, n))})

    rows = own.join(wanted, "doc_id", "left_semi").select("doc_id", F.xxhash64(*COLUMNS).alias("tag"), features(*COLUMNS).alias("f")).groupBy("doc_id").agg(F.min_by("f", "tag").alias("f")).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    known, rest = [r for r in rows if r.doc_id in y], [r for r in rows if r.doc_id not in y]
    words = lambda some: [np.frombuffer(r.f.x, np.uint16) for r in some]
    meta = lambda some: np.array([r.f.z for r in some]).reshape(len(some), 2 * BUCKETS + 1)
    truth = np.array([y[r.doc_id] for r in known])
    fit = np.arange(len(truth)) % 5 != 0  # words are chosen without the rows that co_train holds out
    if len(set(truth[fit])) < 2:
        return none
    out = ToxicModel(telling_words([b for b, k in zip(words(known), fit, strict=True) if k], truth[fit]))
    model = co_train((out.holds(words(known)), meta(known)), truth, (out.holds(words(rest)), meta(rest)))
    return ToxicModel(out.words, model) if model.views else none


def score_column(model: QualityModel, toxic: ToxicModel | None = None):
    """Column function of COLUMNS: struct of the probabilities of both targets, whole texts in one pass."""
    names = ("text_score", "meta_score", "score", "toxic_score")
    toxic = toxic or ToxicModel(np.zeros(0, np.uint16))

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scores(text: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({c: [] for c in names}, dtype=float)
        x, z = _views(text, source, lang, n)
        out = pd.DataFrame(dict(zip(names, (*model.score((x, z)), toxic.score(list(text), z)), strict=True)))
        trim()
        return out

    return lambda docs: scores(*(docs[c].cast("string") for c in COLUMNS[:3]), docs["n_chars"].cast("double"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that the classifier accepts and does not find toxic, with all their columns."""
    scores = score_column(fit_quality(docs, labels), fit_toxic(docs, labels))(docs)
    return docs.where((scores["score"] >= keep) & (scores["toxic_score"] < KEEP))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, text_score, meta_score, score, toxic_score, keep."""
    docs = load(spark, sf_dir, "documents", "doc_id", *COLUMNS)
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    scored = docs.select("doc_id", score_column(fit_quality(docs, labels), fit_toxic(docs, labels))(docs).alias("q"))
    return scored.select("doc_id", "q.*", ((F.col("q.score") >= KEEP) & (F.col("q.toxic_score") < KEEP)).alias("keep"))
