"""Vectorised views of UTF-8 text columns: words, lines and their hashes, in numpy.

All functions take Arrow string arrays and work on the bytes of many texts at once. A word is
a run of bytes other than 0x20 and 0x09-0x0D, so no multi-byte character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of texts that are looked at together; arrays of eight bytes for each stay near the caches.
CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20240607)
_BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int = _ODD) -> np.ndarray:
    """Sums of values[i] * base**i over prefixes; see `spans`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _ODD) -> np.ndarray:
    """Polynomial hash of each span; equal spans have equal hashes wherever they stand."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), base)[1][start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of several texts: byte spans in `data`, `ptr[i]:ptr[i + 1]` belong to text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return spans(prefix(_BYTE_VALUE[self.data]), self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    width = np.int64 if wide else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, width)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, bounds.astype(np.int64) - int(bounds[0])


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    return Words(data, offsets, *runs(~SPACE[data], offsets))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of true that don't cross an offset, and where each text's begin."""
    n = len(inside)
    edge = offsets[offsets < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all n-word windows that lie in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return start, spans(prefix(hashes), start, start + n)


def chunks(batch: pa.RecordBatch, column: str, most_rows: int = 4000, most_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most_bytes` of text (or one row) and `most_rows` rows."""
    offsets = raw(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values[ptr[i]:ptr[i + 1]] for each i, also for empty slices. Floats are added up
    slice by slice, so equal slices have equal sums wherever they stand."""
    if values.dtype.kind == "f":
        out = np.zeros(len(ptr) - 1)
        full = np.flatnonzero(np.diff(ptr) > 0)
        if len(full):
            out[full] = np.add.reduceat(values, ptr[:-1][full])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]
