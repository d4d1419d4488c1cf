"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the word windows that occur twice or more in a
text; the characters inside them, and inside repeated lines, are measured against all
characters in words. A text fails where a share is over its limit.

Defined results: a null text counts as empty; texts without words have coverage 0 and fail
(too few words). Repeated rows give repeated results; ties don't arise, as no row is compared
with another. Columns of the input are carried along; `measures`, `base_failed` and `kept` take the
place of columns of those names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import numbered, renamed

#: n-gram length in words -> largest share of word characters inside repeated n-grams.
COVERAGE_LIMITS = {5: 0.20, 7: 0.18, 10: 0.15}
LINE_LIMIT = 0.25
SYMBOL_LIMIT = 0.30
LEAST_WORDS = 10
REPEAT_PERCENT = 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", "line_chars")]
    + [T.StructField(f"dup_chars_{n}", T.LongType()) for n in COVERAGE_LIMITS]
)


def _twice(key: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(len(key), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _after_first(key: np.ndarray) -> np.ndarray:
    """True where the same key stands earlier."""
    order = np.argsort(key, kind="stable")
    found = np.zeros(len(key), bool)
    found[order[1:]] = key[order[1:]] == key[order[:-1]]
    return found


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of MEASURES for each text."""
    w = tn.words(texts)
    starts_char = (w.data & 0xC0) != 0x80
    chars_before = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(starts_char, out=chars_before[1:])
    width = chars_before[w.end] - chars_before[w.start]
    doc, n = w.doc, len(w.ptr) - 1
    salt = tn.mix64(np.arange(1, n + 1, dtype=np.uint64))
    hashes = w.hashes()
    out = {"n_words": w.counts, "word_chars": tn.sums(width, w.ptr), "n_symbols": tn.sums(_SYMBOL[w.data], w.offsets)}
    for length in COVERAGE_LIMITS:
        at, key = tn.windows(hashes, doc, length)
        hit = at[_twice(key ^ salt[doc[at]])] if len(at) else at
        step = np.bincount(hit, minlength=len(hashes) + 1) - np.bincount(hit + length, minlength=len(hashes) + 1)
        covered = np.cumsum(step[:-1]) > 0
        out[f"dup_chars_{length}"] = tn.sums(width * covered, w.ptr)
        if length == 5:
            out["n_repeat_words"] = tn.sums(covered, w.ptr)
    start, end, ptr = tn.runs(w.data != 10, w.offsets)
    words_before = np.searchsorted(w.start, np.stack([start, end]))
    real = words_before[1] > words_before[0]
    line_doc = np.repeat(np.arange(n), np.diff(ptr))
    key = tn.spans(tn.prefix(tn._BYTE_VALUE[w.data]), start, end) ^ salt[line_doc]
    again = _after_first(key) & real if len(key) else real
    size = chars_before[end] - chars_before[start]
    return out | {
        "n_dup_lines": tn.sums(again, ptr), "n_lines": tn.sums(real, ptr),
        "dup_line_chars": tn.sums(size * again, ptr), "line_chars": tn.sums(size * real, ptr),
    }


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """`numbered(docs)` with a struct column `measures` (MEASURES); whole texts, no shuffle."""
    plain = numbered(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.chunks(batch, f"c{at}"):
                found = measure(part.column(at))
                struct = pa.StructArray.from_arrays([pa.array(np.asarray(found[f.name], np.int64)) for f in MEASURES], names=[f.name for f in MEASURES])
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, "measures"])

    return plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("measures", MEASURES)]))


def verdict(m: str = "measures") -> tuple[F.Column, F.Column]:
    """(base_failed, kept) of a measures column."""
    col = lambda x: F.col(f"{m}.{x}")
    base = (col("n_words") < LEAST_WORDS) | (100 * col("n_repeat_words") > REPEAT_PERCENT * col("n_words"))
    fails = base
    for length, limit in COVERAGE_LIMITS.items():
        fails = fails | (col(f"dup_chars_{length}") * 1000 > round(1000 * limit) * col("word_chars"))
    fails = fails | (col("dup_line_chars") * 1000 > round(1000 * LINE_LIMIT) * col("line_chars"))
    fails = fails | (col("n_symbols") * 1000 > round(1000 * SYMBOL_LIMIT) * col("word_chars"))
    return base, ~fails


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `measures`, `base_failed` and `kept` added."""
    base, kept = verdict()
    return renamed(_measured(docs, text_col), docs, measures="measures", base_failed=base, kept=kept)
