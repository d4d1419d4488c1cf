"""Language identification with spans of mixed-language text.

Each word's letters fall into one script range, which narrows the candidate languages to those
that use the script in training. Every candidate scores the word by smoothed log probabilities
of its character n-grams; a Viterbi pass with a penalty for each change of language then labels
all words of the text, and runs of one label are its spans. Words without a letter score nothing
and join the span around them. The text's language is the label with most letters; its score is
the share of those letters times the language's posterior over the whole text.

Defined results: null text, empty text and text without a letter give `und`, score 0 and no
spans. A script unseen in training leaves all languages as candidates. Among equal scores the
language that sorts first wins. With no labelled row at all every text is `und`. Rows are judged
one by one: repeated rows and other columns change nothing, but `language` takes the place of a
column of that name; an empty table gives an empty result.
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

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 17
SWITCH = 12.0
UNKNOWN = "und"
#: First code point of ranges and the script that starts there (0: none of these).
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00AA, "latin"), (0x0250, "other"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([x for x, _ in SCRIPTS])
_NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(x) for _, x in SCRIPTS])
_LETTER = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x32000)), np.uint8).astype(bool)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b = [wide[at + i] for i in range(4)]
    tail = lambda *xs: sum((x & 63) << (6 * (len(xs) - 1 - i)) for i, x in enumerate(xs))
    value = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | tail(b[1]), np.where(b[0] < 0xF0, (b[0] & 15) << 12 | tail(b[1], b[2]), (b[0] & 7) << 18 | tail(b[1], b[2], b[3]))))
    return at, value


def letters_and_scripts(w: tn.Words) -> tuple[np.ndarray, np.ndarray]:
    """Letters in each word, and the script of its last letter (-1: no letter)."""
    plain = np.zeros(len(w.data), np.int8)
    high = w.data >= 0x80
    letter = ((w.data | 32) >= 97) & ((w.data | 32) <= 122) & ~high
    plain[letter] = _NAMES.index("latin")
    if high.any():
        at, value = code_points(w.data)
        wide = value >= 0x80
        at, value = at[wide], value[wide]
        is_letter = _LETTER[np.minimum(value, len(_LETTER) - 1)]
        letter[at] = is_letter
        plain[at] = _SCRIPT[np.searchsorted(_STARTS, value, side="right") - 1]
    count = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(letter, out=count[1:])
    n = count[w.end] - count[w.start]
    where = np.flatnonzero(letter)
    script = np.full(len(n), -1, np.int8)
    has = n > 0
    script[has] = plain[where[count[w.end[has]] - 1]]
    return n, script


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # log probability by n-gram bucket and language
    by_script: np.ndarray  # candidate or not, by script and language

    def word_scores(self, w: tn.Words) -> tuple[np.ndarray, np.ndarray]:
        """(scores by word and language, letters by word)."""
        letters, script = letters_and_scripts(w)
        first, number = distinct_words(w)
        bucket, bounds = word_grams(w, LENGTHS, BUCKETS, first)
        size = np.diff(bounds)
        score = means(self.table[bucket], bounds) * (size / len(LENGTHS)).reshape(-1, 1)
        score = np.where(self.by_script[script[first]], score, score.min(1, keepdims=True) - 50.0) if len(first) else score
        score[letters[first] == 0] = 0
        return score[number], letters


def fit_language(texts: list[str], labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    counts = np.zeros((BUCKETS, len(languages)))
    uses = np.zeros((len(_NAMES), len(languages)))
    labels = np.array(labels, dtype=object)
    for k, lang in enumerate(languages):
        own = np.array(texts, dtype=object)[labels == lang]
        for i in range(0, len(own), 200):
            w = tn.words(strings(own[i : i + 200]))
            letters, script = letters_and_scripts(w)
            first, number = distinct_words(w)
            times = np.bincount(number, minlength=len(first)) * (letters[first] > 0)
            bucket, bounds = word_grams(w, LENGTHS, BUCKETS, first)
            counts[:, k] += np.bincount(bucket, np.repeat(times, np.diff(bounds)), BUCKETS)
            uses[:, k] += np.bincount(script[script >= 0], minlength=len(_NAMES))
    share = uses / np.maximum(uses.sum(0, keepdims=True), 1)
    by_script = share >= 0.002
    by_script[~by_script.any(1)] = True
    smooth = 0.1
    table = np.log((counts + smooth) / (counts.sum(0) + smooth * BUCKETS))
    return LanguageModel(languages, table.astype(np.float32), by_script)


def viterbi(scores: np.ndarray, ptr: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; texts of `ptr` are labelled side by side, one word at a time."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    begin, size = ptr[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    best = np.zeros(len(scores), np.int32)
    stays = np.zeros(scores.shape, bool)
    state = np.zeros((len(size), scores.shape[1]))
    label = np.zeros(len(scores), np.int32)
    for t in range(steps):
        m = active[t]
        at, now = begin[:m] + t, state[:m]
        if t:
            top = now.argmax(1)
            change = now[np.arange(m), top][:, None] - switch
            best[at] = top
            keep = now >= change
            stays[at] = keep
            now = np.where(keep, now, change)
        state[:m] = now + scores[at]
    last = state.argmax(1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = last[:m]
        if t:
            last[:m] = np.where(stays[at, last[:m]], last[:m], best[at])
    return label


RESULT = "lang_pred string, score double, spans array<struct<lang: string, first_word: int, n_words: int>>"


def identify(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language number or -1, score, spans as (bounds by text, language, first word, words))."""
    w = tn.words(texts)
    n, k = len(w.ptr) - 1, len(model.languages)
    if not k:
        none = np.zeros(0, np.int64)
        return np.full(n, -1), np.zeros(n), (np.zeros(n + 1, np.int64), none, none, none)
    scores, letters = model.word_scores(w)
    label = viterbi(scores, w.ptr)
    doc = w.doc
    weight = np.bincount(doc * k + label, letters, n * k).reshape(n, k)
    total = weight.sum(1)
    pred = np.where(total > 0, weight.argmax(1), -1)
    whole = np.stack([tn.sums(scores[:, i], w.ptr) for i in range(k)], 1)
    whole -= whole.max(1, keepdims=True)
    odds = np.exp(whole)
    rows = np.arange(n)
    score = np.where(total > 0, weight[rows, pred] / np.maximum(total, 1) * odds[rows, pred] / odds.sum(1), 0.0)
    some = total[doc] > 0
    change = some.copy()
    if len(doc) > 1:
        change[1:] &= (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change)
    bounds = np.searchsorted(doc[first], np.arange(n + 1))
    after = np.minimum(np.append(first[1:], len(doc)), w.ptr[doc[first] + 1]) if len(first) else first
    return pred, score, (bounds, label[first], first - w.ptr[doc[first]], after - first)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with a struct column `language` (lang_pred, score, spans) added; no shuffle."""
    plain = numbered(docs)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a few languages
    words = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = pa.array(words)
        for batch in batches:
            for part in tn.chunks(batch, f"c{at}"):
                pred, score, (bounds, lang, first, size) = identify(part.column(at), model)
                one = pa.StructArray.from_arrays([known.take(pa.array(lang.astype(np.int64))), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], names=["lang", "first_word", "n_words"])
                spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), one)
                found = pa.StructArray.from_arrays([known.take(pa.array(np.where(pred < 0, len(words) - 1, pred))), pa.array(score), spans], names=["lang_pred", "score", "spans"])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "language"])

    inner = T.StructType([*plain.schema, T.StructField("language", T.StructType.fromDDL(RESULT))])
    return renamed(plain.mapInArrow(run, inner), docs, language="language")
