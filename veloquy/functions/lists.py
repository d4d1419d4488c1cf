"""Lists of a search index, block by block, in numpy over Arrow batches.

Both functions go to `mapInArrow` over rows of which those of a block stand together: each task holds one
block at a time, and what it gives are whole lists, so that rows of a list are never shuffled one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a character in a run's number; 0 stands for none, so that runs may be cut short.
BITS = 21
POSTINGS = "term string, block long, n long, max_f int, min_length int, rows array<tinyint>, fs array<int>"
GRAMS = "gram string, block long, rows array<tinyint>"


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block after the other; one that goes on in the next batch is put together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        blocks = rows.column("block").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield rows.slice(lo, hi - lo)
        rest = rows.slice(bounds[-2])
    if rest is not None:
        yield rest


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _arrays(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), pa.array(values, kind))


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTINGS of rows (block, row, length, tokens): each term of a block with the rows that hold it, in
    order, and how often each does."""
    for block in _whole_blocks(batches):
        tokens, owner = pc.list_flatten(block.column("tokens")), pc.list_parent_indices(block.column("tokens")).to_numpy()
        if tokens.null_count:
            owner, tokens = owner[pc.is_valid(tokens).to_numpy(zero_copy_only=False)], tokens.drop_null()
        if not len(tokens):
            continue
        coded = tokens.dictionary_encode()
        # (term, place in the block), each once.
        both, f = np.unique(coded.indices.to_numpy().astype(np.int64) * block.num_rows + owner, return_counts=True)
        code, place = both // block.num_rows, both % block.num_rows
        starts = _starts(code)
        length = block.column("length").to_numpy()[place]
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(code[starts])), pa.array(np.full(len(starts), block.column("block")[0].as_py())), pa.array(np.diff(np.r_[starts, len(code)]), pa.int64()),
                pa.array(np.maximum.reduceat(f, starts), pa.int32()), pa.array(np.minimum.reduceat(length, starts), pa.int32()),
                _arrays(starts, block.column("row").to_numpy()[place], pa.int8()), _arrays(starts, f, pa.int32()),
            ], ["term", "block", "n", "max_f", "min_length", "rows", "fs"],
        )


def _runs(text: bytes) -> np.ndarray:
    """The distinct numbers of the runs of three characters of a text, one from each character."""
    chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    padded = np.r_[chars, 0, 0]
    return np.unique(padded[:-2] << 2 * BITS | padded[1:-1] << BITS | padded[2:])


def _names(codes: np.ndarray) -> pa.Array:
    mask = (1 << BITS) - 1
    parts = np.stack([codes >> 2 * BITS, codes >> BITS & mask, codes & mask], 1)
    if (parts == 1).any():
        # numpy ends a text at a character of number 0.
        return pa.array(["".join(chr(c - 1) for c in run if c) for run in parts.tolist()], pa.string())
    return pa.array(np.ascontiguousarray(np.maximum(parts - 1, 0).astype(np.uint32)).view("<U3").reshape(-1).tolist(), pa.string())


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GRAMS of rows (block, row, text): each run of three characters of a block with the rows that hold it."""
    for block in _whole_blocks(batches):
        found = [_runs(text) for text in block.column("text").cast(pa.binary()).to_pylist()]
        code, place = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(code, kind="stable")
        code, row = code[order], block.column("row").to_numpy()[place[order]]
        starts = _starts(code)
        yield pa.RecordBatch.from_arrays(
            [_names(code[starts]), pa.array(np.full(len(starts), block.column("block")[0].as_py())), _arrays(starts, row, pa.int8())], ["gram", "block", "rows"]
        )
