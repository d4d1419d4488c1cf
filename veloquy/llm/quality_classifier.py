"""Quality by Bradley-Terry pairwise ranking.

Each text has measures of its form (length, letters, case, symbols, repetition, lines). Each
measure is cut at sample quantiles into indicator features, so that a weighted sum can follow any
shape. Weights are learned from preference pairs (a text labelled 1 over one labelled 0) by
logistic loss on the difference of the two texts' features. The weights are learned on a sample;
the threshold is the quantile, over all labelled training texts, that the share of preferred ones
gives; the reported score is a logistic of the distance to it,
0.7 at the threshold.

Defined results: null text counts as empty. Without labelled rows, or with labels of one class,
every score is 0.7 for class 1 and 0.3 for class 0 (0.5 without rows). Rows are scored one by
one: repeated rows, ties and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import stored
from .grams import distinct_words, strings
from .quality_rules import measure
from .toxicity import with_score

BINS = 16
PAIRS = 200_000
STEPS = 400
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.7


def _share(table: set[int] | bytes, w: tn.Words) -> np.ndarray:
    flag = np.zeros(256, bool)
    flag[list(table)] = True
    return tn.sums(flag[w.data], w.offsets)


def features(texts: pa.Array) -> np.ndarray:
    """Measures of form, one row for each text."""
    w = tn.words(texts)
    m = measure(texts)
    size = np.maximum(np.diff(w.offsets), 1)
    n = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    upper, lower = _share(range(65, 91), w), _share(range(97, 123), w)
    _, number = distinct_words(w)
    doc = w.doc
    distinct = np.bincount(np.unique(doc * (len(w.start) + 1) + number) // (len(w.start) + 1), minlength=len(n))
    width = w.end - w.start
    columns = [
        np.log1p(m["n_words"]), np.log1p(m["word_chars"]) - np.log1p(m["n_words"]), upper / np.maximum(upper + lower, 1), m["n_symbols"] / chars,
        _share(range(48, 58), w) / size, _share(b"!?", w) / n, _share(b".", w) / n, _share(b",", w) / n, _share(b"|", w) / n, _share(b"#*$%&", w) / n,
        _share(range(128, 256), w) / size, m["n_lines"] / n, np.log1p(m["n_words"] / np.maximum(m["n_lines"], 1)), m["dup_line_chars"] / np.maximum(m["line_chars"], 1),
        m["dup_chars_5"] / chars, m["dup_chars_10"] / chars, distinct / n, tn.sums(width <= 3, w.ptr) / n, tn.sums(width >= 15, w.ptr) / n,
        _share(b"{}[]()=;_\\/@\"'", w) / n,
    ]
    return np.stack(columns, 1).astype(np.float64)


@dataclass
class QualityModel:
    cuts: np.ndarray  # by measure, BINS - 1 each
    weights: np.ndarray  # by measure and bin
    threshold: float
    slope: float
    fixed: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self.weights[i][np.searchsorted(c, x[:, i], side="right")] for i, c in enumerate(self.cuts)), np.zeros(len(x)))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(texts), self.fixed)
        z = (self.raw(features(texts)) - self.threshold) * self.slope + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_quality(texts: list[str], labels: np.ndarray, prior: float | None = None, seed: int = 0) -> QualityModel:
    """`prior`: the share of class 1 in the table that the sample was drawn from."""
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        return QualityModel(np.zeros((0, BINS - 1)), np.zeros((0, BINS)), 0.0, 1.0, 0.5 if len(labels) == 0 else (0.7 if labels[0] else 0.3))
    prior = float(labels.mean()) if prior is None else prior
    whole = strings(texts)
    x = np.concatenate([features(whole[i : i + 500]) for i in range(0, len(whole), 500)])
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    code = np.stack([np.searchsorted(c, x[:, i], side="right") + i * BINS for i, c in enumerate(cuts)], 1)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w = np.zeros(code.shape[1] * BINS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        at = rng.integers(0, PAIRS, 8192)
        a, b = code[better[at]], code[worse[at]]
        p = 1 / (1 + np.exp(np.clip(w[a].sum(1) - w[b].sum(1), -30, 30)))  # of the wrong order
        each = np.repeat(p / len(at), code.shape[1])
        g = np.bincount(b.reshape(-1), each, len(w)) - np.bincount(a.reshape(-1), each, len(w)) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    raw = w[code].sum(1)
    weight = np.where(labels == 1, prior / len(good), (1 - prior) / len(bad))
    order = np.argsort(raw)
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, 1 - prior)), len(raw) - 2)
    threshold = float(raw[order[at : at + 2]].mean())
    return QualityModel(cuts, w.reshape(-1, BINS), threshold, 1.0)


@dataclass
class _Raw:
    """The model's sum of weights as a score."""

    model: QualityModel

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.model.raw(features(texts))


def threshold_of(raw: DataFrame, prior: float) -> float | None:
    """The cut of column `raw` that leaves the share `prior` of the rows above it, half way to the
    next value; ranks within a millionth of the rows."""
    at = raw.agg(F.percentile_approx("raw", 1 - prior, 1_000_000)).first()[0]
    if at is None:
        return None
    above = raw.filter(F.col("raw") > at).agg(F.min("raw")).first()[0]
    return at if above is None else (at + above) / 2


def quality_scores(docs: DataFrame, model: QualityModel, labels: DataFrame, prior: float | None) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, score): each text is measured once, then the threshold is taken
    over all rows with an id in `labels`."""
    if model.fixed is not None:
        return with_score(docs, model).select("doc_id", "score")
    raw = stored(with_score(docs, _Raw(model), name="raw").select("doc_id", "raw"), "quality")
    found = threshold_of(raw.join(labels, "doc_id"), prior)
    z = (F.col("raw") - F.lit(model.threshold if found is None else found)) * model.slope + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return raw.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
