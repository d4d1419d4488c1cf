"""Character n-grams of words as table rows, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textnum as tn

EDGE = np.uint64(0x632BE59BD9B4E019)


def word_grams(w: tn.Words, lengths: tuple[int, ...], buckets: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, bounds of each word's n-grams) for the words `which` (all).

    N-grams are over the bytes of the word between two edge marks, and never cut a character.
    """
    start, end = (w.start, w.end) if which is None else (w.start[which], w.end[which])
    size = end - start
    total = int(size.sum()) + 2 * len(size)
    at = np.cumsum(size + 2) - size - 2
    word = np.repeat(np.arange(len(size)), size + 2)
    local = np.arange(total) - at[word]
    inside = (local > 0) & (local <= size[word])
    value = np.full(total, EDGE, np.uint64)
    byte = w.data[start[word[inside]] + local[inside] - 1]
    value[inside] = tn._BYTE_VALUE[byte]
    cut = np.ones(total, bool)  # a character starts here
    cut[inside] = (byte & 0xC0) != 0x80
    first = np.flatnonzero(cut)
    owner = word[first]
    edge = np.append(first, total)
    sums = tn.prefix(value)
    found, held = [], []
    for n in lengths:
        if len(first) < n:
            continue
        ok = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        found.append(tn.spans(sums, edge[ok], edge[ok + n]) ^ np.uint64(n))
        held.append(owner[ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
    key, who = np.concatenate(found), np.concatenate(held)
    order = np.argsort(who, kind="stable")
    bucket = (tn.mix64(key[order]) >> np.uint64(20)).astype(np.int64) % buckets
    return bucket, np.searchsorted(who[order], np.arange(len(size) + 1))


def distinct_words(w: tn.Words) -> tuple[np.ndarray, np.ndarray]:
    """(position of one occurrence of each distinct word, distinct number of each word)."""
    _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of values[bounds[i]:bounds[i + 1]], along the first axis; 0 for empty slices."""
    size = np.diff(bounds)
    out = np.zeros((len(size), *values.shape[1:]))
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out / np.maximum(size, 1).reshape(-1, *[1] * (values.ndim - 1))


def strings(texts) -> pa.Array:
    return pa.array(list(texts), pa.string())
