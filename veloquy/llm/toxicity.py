"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word's vector is half its own and half the mean of the vectors of its character n-grams (3 to
5, hashed to BUCKETS rows), a text's vector the mean over its distinct words; a linear softmax over the two classes and all
n-gram vectors are fitted together by Adam, classes in balance,
on a bounded sample (ROWS_A_LABEL, SAMPLE_CHARS). A
text's words count once each, so that no repeated word drowns the others. Misspelt words share
most n-grams with the words seen, and so their vectors.

Defined results: null and empty texts, and texts without words, get the score of the bias alone.
With no labelled rows, or labels of one class, every score is the share of that class (0.5
without rows). Rows are scored one by one: repeated rows, ties and other columns change nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textnum as tn
from .common import numbered, renamed
from .grams import distinct_words, means, strings, word_grams

LENGTHS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 4
EPOCHS = 60
RATE = 0.05
STEADY = 1e-8
#: Texts are long and few words matter: the mean is scaled before the softmax.
SCALE = 30.0
DECAY = 3e-6
#: Words and n-grams in fewer texts have no vector of their own.
LEAST_USES = 6
ROWS_A_LABEL = 2500
SAMPLE_CHARS = 9_000_000


@dataclass
class ToxicityModel:
    by_bucket: np.ndarray  # difference of the two classes' logits for each n-gram
    words: np.ndarray  # sorted hashes of the words with vectors of their own
    by_word: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        w = tn.words(texts, lower=True)
        first, number = distinct_words(w)
        bucket, bounds = word_grams(w, LENGTHS, BUCKETS, first)
        word = means(self.by_bucket[bucket], bounds) / 2
        key = w.hashes()[first]
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        if len(self.words):
            word += np.where(self.words[at] == key, self.by_word[at], 0) / 2
        doc, own = _bags(w, number, len(first))
        logit = means(word[own], np.searchsorted(doc, np.arange(len(w.ptr)))) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _bags(w: tn.Words, number: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) pairs: each text's distinct words."""
    pair = np.unique(w.doc * max(n_words, 1) + number)
    return pair // max(n_words, 1), pair % max(n_words, 1)


def _reach(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How far a row's vector counts, 0 to 1, by the significance of its uses' difference between
    the classes; 0 within chance or with few uses. Rare n-grams can't learn single texts by heart."""
    n0, n1 = max(clean.sum(), 1), max(toxic.sum(), 1)
    both = np.maximum(clean + toxic, 1)
    z = np.abs(toxic / n1 - clean / n0) / np.sqrt(both / (n0 + n1) * (1 / n0 + 1 / n1))
    return np.where(clean + toxic >= LEAST_USES, np.clip((z - 2) / 8, 0, 1), 0).astype(np.float32)


def _groups(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts by key, starts of the keys present, those keys)."""
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(bounds) > 0)
    return order, bounds[full], full


def _gathered(values: np.ndarray, groups: tuple, n: int) -> np.ndarray:
    order, starts, full = groups
    out = np.zeros((n, values.shape[1]), np.float32)
    out[full] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _indexed(texts: list[str], at_once: int = 200) -> tuple[np.ndarray, ...]:
    """(text, word) pairs, buckets and bounds of the n-grams of each distinct word, and its hash,
    made from `at_once` texts at a time."""
    docs, keys, owners, buckets, sizes = [], [], [], [], []
    seen = 0
    for i in range(0, len(texts), at_once):
        w = tn.words(strings(texts[i : i + at_once]), lower=True)
        first, number = distinct_words(w)
        doc, own = _bags(w, number, len(first))
        docs.append(doc + i)
        owners.append(own + seen)
        seen += len(first)
        keys.append(w.hashes()[first])
        bucket, bounds = word_grams(w, LENGTHS, BUCKETS, first)
        buckets.append(bucket.astype(np.int32))
        sizes.append(np.diff(bounds))
    key, one, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)
    all_bounds = np.append(0, np.cumsum(size))
    kept = np.repeat(all_bounds[one] - np.cumsum(size[one]) + size[one], size[one]) + np.arange(int(size[one].sum()))
    return np.concatenate(docs), number.reshape(-1)[np.concatenate(owners)], np.concatenate(buckets)[kept], np.append(0, np.cumsum(size[one])), key


def fit_toxicity(texts: list[str], labels: np.ndarray, prior: float | None = None, seed: int = 0) -> ToxicityModel:
    """`prior`: the share of class 1 in the table that the sample was drawn from."""
    labels = np.asarray(labels, np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    prior = share if prior is None else prior
    if len(labels) == 0 or share in (0.0, 1.0):
        none = np.zeros(0)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), none.astype(np.uint64), none, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))) if len(labels) else 0.0)
    doc, word, bucket, bounds, key = _indexed(texts)
    n_docs, n_words = len(texts), len(bounds) - 1
    part = (1.0 / np.bincount(doc, minlength=n_docs))[doc].astype(np.float32)[:, None]
    size = np.diff(bounds)
    gram_word = np.repeat(np.arange(n_words), size)
    uses = [np.bincount(word[labels[doc] == c], minlength=n_words) for c in (0, 1)]
    own = np.flatnonzero(uses[0] + uses[1] >= LEAST_USES)
    rows = np.append(bucket, BUCKETS + np.arange(len(own)))
    row_word = np.append(gram_word, own)
    row_part = np.append((0.5 / np.maximum(size, 1))[gram_word], np.full(len(own), 0.5)).astype(np.float32)
    n_rows = BUCKETS + len(own)
    reach = _reach(*[np.bincount(rows, u[row_word], n_rows) for u in uses])
    known = reach[rows] > 0
    bucket, gram_word, gram_part = rows[known], row_word[known], (row_part * reach[rows])[known][:, None]
    to_doc, to_word, to_bucket, of_word = _groups(doc, n_docs), _groups(word, n_words), _groups(bucket, n_rows), _groups(gram_word, n_words)
    rng = np.random.default_rng(seed)
    params = {"e": rng.normal(0, 0.01, (n_rows, DIM)).astype(np.float32), "v": rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    params["e"][np.bincount(bucket, minlength=n_rows) == 0] = 0
    first_moment = {k: np.zeros_like(x) for k, x in params.items()}
    second_moment = {k: np.zeros_like(x) for k, x in params.items()}
    goal = np.eye(2, dtype=np.float32)[labels]
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n_docs - labels.sum())).astype(np.float32)[:, None]
    grams_only = gram_part * (bucket < BUCKETS)[:, None]
    for step in range(1, EPOCHS + 1):
        # Every other step does without the words' own vectors, as unseen spellings must.
        held = gram_part if step % 2 else grams_only
        vec = _gathered(params["e"][bucket] * held, of_word, n_words)
        mean = _gathered(vec[word] * part, to_doc, n_docs) * SCALE
        logit = mean @ params["v"] + params["b"]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - goal) * balance
        back = (d @ params["v"].T) * SCALE
        g_word = _gathered(back[doc] * part, to_word, n_words)
        grads = {"e": _gathered(g_word[gram_word] * held, to_bucket, n_rows) + DECAY * params["e"], "v": mean.T @ d, "b": d.sum(0)}
        for k, g in grads.items():
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
            params[k] = params[k] - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + STEADY)
    line = params["v"][:, 1] - params["v"][:, 0]
    moved = 0.3 * np.log(prior / (1 - prior))
    logit_of = (params["e"] @ line * SCALE * reach).astype(np.float32)
    return ToxicityModel(logit_of[:BUCKETS], key[own], logit_of[BUCKETS:], float(params["b"][1] - params["b"][0] + moved))


def with_score(docs: DataFrame, model, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the model's score of each whole text added, in place of a column of that name;
    no shuffle. The model has a `score` method on Arrow string arrays and a size that doesn't grow
    with the data."""
    plain = numbered(docs)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tn.chunks(batch, f"c{at}"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.asarray(model.score(part.column(at)), np.float64))], names=[*part.schema.names, "score"])

    inner = T.StructType([*plain.schema, T.StructField("score", T.DoubleType())])
    return renamed(plain.mapInArrow(run, inner), docs, **{name: "score"})
