"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Pieces are read from a model file, of the unigram or the BPE kind. A text gets a space in front
(if the file asks for it) and is cut into units, each a run of spaces with what follows up to the
next space; no piece crosses such a cut. Distinct units of one length are searched side by side: for every end position
the hashes of all substrings that end there probe the sorted piece keys, the best start is found
for all units at once, and it is the backpointer (the earliest among equals).

Unigram: the best sum of scores. A character that no piece covers costs ten less than the least
score. BPE: scores of pieces are the order of merges and don't add up. Merging in that order ends
in the one path on which every piece is what its own text merges to and no two neighbours would
have merged otherwise; so a start counts only if the last piece before it may stand beside the new
one (`_neighbours_hold`), and the search gives the pieces that merging gives. In both kinds
uncovered characters are written as byte pieces.

Other than the library, the space mark U+2581 itself, if it stands in a text, is written as bytes,
so decoding gives back every text exactly. Files that ask for other normalisation, spaces at the
end of words or pieces with spaces inside are refused.

Defined results: null text gives null pieces, and null pieces decode to null; empty text gives
no pieces and back. Texts are encoded one by one: repeated rows, ties and other columns change
nothing, but the added column takes the place of one of its name; an empty table gives an empty result.
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

MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
PENALTY = 10.0
UNIGRAM, BPE = 1, 2
#: Pairs of neighbours whose verdict a task remembers, as a power of two.
MEMO_BITS = 18
#: First bits of hashes that are looked at before the sorted keys.
SIEVE_BITS = 20
#: Bytes of texts whose distinct units are searched once.
TEXT_BYTES = 2 << 20
#: Units, and pieces of them, that a task remembers from batch to batch.
MEMO_UNITS, MEMO_IDS = 300_000, 2_000_000
#: Units of one length that are searched together.
SIDE_BY_SIDE = 20_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Merges:
    """What tells which BPE pieces may be neighbours; by number of the sorted piece keys."""

    rank: np.ndarray  # characters first, then pieces in order of merging
    left: np.ndarray  # the two pieces that merge into one, -1 for a character
    right: np.ndarray
    sum: np.ndarray  # hash of the bytes before it is mixed
    size: np.ndarray  # bytes
    memo: tuple[np.ndarray, np.ndarray]


@dataclass
class Units:
    """Units met lately and their pieces: those of unit i are ids[start[i]:start[i] + size[i]]."""

    keys: np.ndarray  # sorted
    start: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls) -> Units:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))


@dataclass
class PieceModel:
    keys: np.ndarray  # sorted hashes of the pieces that match text
    ids: np.ndarray  # their ids; -1: a character that is only part of pieces
    scores: np.ndarray
    longest: int  # characters of the longest piece
    byte_ids: np.ndarray  # id of each byte's piece
    flat: np.ndarray  # bytes of all pieces as they decode
    bounds: np.ndarray
    missing: float
    prefix: bool  # a space goes in front
    merges: Merges | None
    units: Units
    sieve: np.ndarray  # whether any key begins with these SIEVE_BITS

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the piece of each hash, whether there is one)."""
        found = self.sieve[(key >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
        some = key[found]
        place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        at = np.zeros(key.shape, np.int64)
        at[found] = place
        found[found] = self.keys[place] == some
        return at, found


def _merged(text: str, score: dict[str, float]) -> tuple[str, str] | None:
    """The two parts that merge last into `text`; None if merging ends otherwise."""
    parts = list(text)
    while len(parts) > 2:
        each = [score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        best = max(range(len(each)), key=each.__getitem__)
        if each[best] == -np.inf:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _keyed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, its unmixed form, size in bytes) of each text."""
    data, offsets = tn.raw(pa.array(texts, pa.string()))
    sums = tn.prefix(tn._BYTE_VALUE[data])
    start, end = offsets[:-1], offsets[1:]
    return tn.spans(sums, start, end), (sums[end] - sums[start]) * tn.powers(len(sums))[1][start], end - start


def parse_model(data: bytes) -> PieceModel:
    pieces, trainer, rules = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            one = dict(fields(value))
            pieces.append((one[1], float(np.frombuffer(one.get(2, b"\0" * 4), "<f4")[0]), one.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            rules = dict(fields(value))
    kind_of_model = trainer.get(3, UNIGRAM)
    if kind_of_model not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are known")
    if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model changes texts in a way that decoding can't undo")
    shown, match, byte_ids = [], [], np.full(256, -1)
    for i, (raw, score, kind) in enumerate(pieces):
        if kind == BYTE:
            value = int(raw[1:-1], 16)
            byte_ids[value] = i
            shown.append(bytes([value]))
        elif kind in (NORMAL, USER):
            text = raw.replace(MARK, b" ")
            shown.append(text)
            match.append((text.decode(), i, score))
            if kind == USER and kind_of_model == BPE or b" " in text.lstrip(b" "):
                raise ValueError("pieces with spaces inside, and a user's own in a BPE model, are not known")
        else:
            shown.append(b"")
    if (byte_ids < 0).any():
        raise ValueError("the model has no piece for some bytes")
    parts: dict[str, tuple[str, str] | None] = {}
    if kind_of_model == BPE:
        score_of = {t: s for t, _, s in match}
        parts = {t: _merged(t, score_of) for t in score_of if len(t) > 1}
        match = [m for m in match if len(m[0]) == 1 or parts[m[0]]]
        match += [(c, -1, 0.0) for c in sorted({c for t, _, _ in match for c in t} - score_of.keys())]
    bounds = np.cumsum([0, *map(len, shown)])
    keys, sums, sizes = _keyed([t for t, _, _ in match])
    order = np.argsort(keys)
    scores = np.array([s for _, _, s in match])
    merges = None
    if kind_of_model == BPE:
        texts = [match[i][0] for i in order]
        place = {t: i for i, t in enumerate(texts)}
        by_rank = sorted(range(len(texts)), key=lambda i: (len(texts[i]) > 1, -scores[order[i]] if len(texts[i]) > 1 else 0.0, i))
        rank = np.empty(len(texts), np.int64)
        rank[by_rank] = np.arange(len(texts))
        split = np.array([[place[x] for x in parts[t]] if parts.get(t) else [-1, -1] for t in texts])
        merges = Merges(rank, split[:, 0], split[:, 1], sums[order], sizes[order], (np.full(1 << MEMO_BITS, -1), np.zeros(1 << MEMO_BITS, bool)))
    least = float(scores.min()) - PENALTY
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[(keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
    return PieceModel(keys[order], np.array([i for _, i, _ in match])[order], scores[order], max(len(t) for t, _, _ in match), byte_ids, np.frombuffer(b"".join(shown), np.uint8), bounds, least, bool(rules.get(3, 1)), merges, Units.none(), sieve)


def _neighbours_hold(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the text of pieces `a` and `b` ends in just these two: from the cut, down
    the parts on either side, no two that meet merge before the later one of them was made."""
    m = model.merges
    hold = np.ones(len(a), bool)
    at, limit = np.arange(len(a)), np.full(len(a), len(m.rank))
    a, b = a.copy(), b.copy()
    power = tn.powers(int(m.size.max()) + 1)[0]
    while len(at):
        size = m.size[a] + m.size[b]
        key = tn.mix64(m.sum[a] + power[m.size[a]] * m.sum[b] + size.astype(np.uint64))
        made, exists = model.find(key)
        broken = exists & (m.rank[made] < limit)
        hold[at[broken]] = False
        go = ~broken
        at, a, b = at[go], a[go], b[go]
        rank_a, rank_b = m.rank[a], m.rank[b]
        more_a, more_b = m.right[a] >= 0, m.left[b] >= 0
        by_a = more_a & ((rank_a > rank_b) | ~more_b)
        limit = np.where(by_a, rank_a, rank_b + 1)
        a, b = np.where(by_a, m.right[a], a), np.where(by_a | ~more_b, b, m.left[b])
        go = more_a | more_b
        at, a, b, limit = at[go], a[go], b[go], limit[go]
    return hold


def _remembered(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`_neighbours_hold`, computed once for pairs met lately."""
    pair = a.astype(np.int64) * len(model.keys) + b
    slot = (tn.mix64(pair.astype(np.uint64)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
    known, verdict = model.merges.memo
    hold = verdict[slot]
    new = np.flatnonzero(known[slot] != pair)
    if len(new):
        one, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
        made = _neighbours_hold(model, a[new[first]], b[new[first]])
        hold[new] = made[back.reshape(-1)]
        place = slot[new[first]]
        known[place], verdict[place] = one, made
        # Two pairs of one place: the last key stays, with its own verdict.
        twice = known[place] == one
        verdict[place[twice]] = made[twice]
    return hold


def _best(model: PieceModel, sums: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpointers and piece numbers (-1: none) by unit and end, for units of one length whose
    characters start at the byte positions `char` (units x length + 1)."""
    n = char.shape[1] - 1
    total = np.zeros((len(char), n + 1))
    back = np.zeros((len(char), n + 1), np.int32)
    piece = np.full((len(char), n + 1), -1, np.int32)
    rows = np.arange(len(char))
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - model.longest), end)
        key = tn.spans(sums, char[:, starts], char[:, [end]])
        at, found = model.find(key)
        if model.merges is None:
            value = np.where(found, model.scores[at], -np.inf)
            value[:, -1] = np.where(found[:, -1], value[:, -1], model.missing)
            value = value + total[:, starts]
        else:
            row, col = np.nonzero(found)
            last = piece[row, starts[col]]
            check = np.flatnonzero((last >= 0) & (starts[col] > 0))
            holds = np.ones(len(row), bool)
            holds[check] = _remembered(model, last[check], at[row[check], col[check]])
            value = np.full(found.shape, -np.inf)
            value[row[holds], col[holds]] = 1.0
            value[:, -1] = np.maximum(value[:, -1], 0.0)
        top = value.argmax(1)
        total[:, end] = value[rows, top]
        back[:, end] = starts[top]
        piece[:, end] = np.where(found[rows, top], at[rows, top], -1)
    return back, piece


def _units(model: PieceModel, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the pieces of each unit data[start:end]."""
    size = end - start
    base = np.cumsum(size) - size
    flat = data[np.repeat(start - base, size) + np.arange(int(size.sum()))]
    sums = tn.prefix(tn._BYTE_VALUE[flat])
    first = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))
    at = np.searchsorted(first, base)
    length = np.searchsorted(first, base + size) - at
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, place from the end, id
    for n in np.unique(length):
        same = np.flatnonzero(length == n)
        most = max(1, min(SIDE_BY_SIDE, 4_000_000 // (int(n) * model.longest)))
        for i in range(0, len(same), most):
            unit = same[i : i + most]
            char = first[at[unit][:, None] + np.arange(n + 1)]
            back, piece = _best(model, sums, char)
            rows, pos, place = np.arange(len(unit)), np.full(len(unit), n), np.zeros(len(unit), np.int64)
            while len(rows):
                which, begin = piece[rows, pos], back[rows, pos]
                whole = (which >= 0) & (model.ids[which] >= 0)
                held.append((unit[rows[whole]], place[rows[whole]], model.ids[which[whole]]))
                lone = rows[~whole]
                if len(lone):
                    low, high = char[lone, begin[~whole]], char[lone, pos[~whole]]
                    for back_by in range(1, 5):
                        ok = high - back_by >= low
                        held.append((unit[lone[ok]], place[lone[ok]] + back_by - 1, model.byte_ids[flat[high[ok] - back_by]]))
                    place[lone] += high - low - 1
                place[rows] += 1
                go = begin > 0
                rows, pos = rows[go], begin[go]
    unit, place, ids = (np.concatenate([h[i] for h in held]) for i in range(3)) if held else (np.zeros(0, np.int64),) * 3
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.bincount(unit, minlength=len(start)), out=bounds[1:])
    out = np.empty(len(ids), np.int32)
    out[bounds[unit + 1] - 1 - place] = ids
    return out, bounds


def _gather(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all elements of the lists `which`, bounds of the result)."""
    size = np.diff(bounds)[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return np.repeat(bounds[which] - out[:-1], size) + np.arange(int(out[-1])), out


def encode(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds by text); nulls and empty texts have no pieces."""
    plain, offsets = tn.raw(texts)
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    shift = np.cumsum(size > 0) * model.prefix
    data = np.full(len(plain) + len(full) * model.prefix, 32, np.uint8)
    data[np.arange(len(plain)) + np.repeat(shift, size)] = plain
    doc_start = offsets[:-1][full] + np.arange(len(full)) * model.prefix
    space = data == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[doc_start] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(data))
    key = tn.spans(tn.prefix(tn._BYTE_VALUE[data]), start, end)
    key, one, number = np.unique(key, return_index=True, return_inverse=True)
    known = _known_units(model, key, data, start[one], end[one])
    per_unit = known.size[number.reshape(-1)]
    before = np.cumsum(per_unit) - per_unit
    at = np.repeat(known.start[number.reshape(-1)] - before, per_unit) + np.arange(int(per_unit.sum()))
    per_text = np.searchsorted(start, np.append(doc_start, len(data)))
    out = np.zeros(len(size) + 1, np.int64)
    out[full + 1] = tn.sums(per_unit, per_text)
    return known.ids[at], np.cumsum(out)


def _known_units(model: PieceModel, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Units:
    """The pieces of the distinct units data[start:end] of sorted hashes `key`; searched only for
    those that the batches before have not had. At most MEMO_UNITS and MEMO_IDS are remembered."""
    held = model.units
    at = np.minimum(np.searchsorted(held.keys, key), max(len(held.keys) - 1, 0))
    seen = held.keys[at] == key if len(held.keys) else np.zeros(len(key), bool)
    new = np.flatnonzero(~seen)
    ids, bounds = _units(model, data, start[new], end[new])
    where, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    where[seen], size[seen] = held.start[at[seen]], held.size[at[seen]]
    where[new], size[new] = len(held.ids) + bounds[:-1], np.diff(bounds)
    found = Units(key, where, size, np.concatenate([held.ids, ids]))
    if len(held.keys) + len(new) <= MEMO_UNITS and len(found.ids) <= MEMO_IDS:
        keys = np.concatenate([held.keys, key[new]])
        order = np.argsort(keys, kind="stable")
        model.units = Units(keys[order], np.concatenate([held.start, where[new]])[order], np.concatenate([held.size, size[new]])[order], found.ids)
    else:  # start anew from the units of this batch, the frequent ones among them
        begin = np.cumsum(size) - size
        some = int(min(len(key), MEMO_UNITS) if size.sum() <= MEMO_IDS else 0)
        own = found.ids[np.repeat(where[:some] - begin[:some], size[:some]) + np.arange(int(size[:some].sum()))]
        model.units = Units(key[:some], begin[:some], size[:some], own)
    return found


def decode(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by text) of the piece ids ids[bounds[i]:bounds[i + 1]]."""
    at, piece_bounds = _gather(model.bounds, ids)
    data = model.flat[at]
    offsets = piece_bounds[bounds]
    keep = np.ones(len(data), bool)
    full = (np.diff(offsets) > 0) & model.prefix
    lead = offsets[:-1][full]
    keep[lead[data[lead] == 32]] = False
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return data[keep], kept[offsets]


def _mapped(docs: DataFrame, column: str, name: str, kind: T.DataType, model: bytes | PieceModel, work) -> DataFrame:
    plain = numbered(docs)
    at = plain.columns[docs.columns.index(column)]
    shared = docs.sparkSession.sparkContext.broadcast(parse_model(model) if isinstance(model, bytes) else model)  # one model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in work(model, batch, at):
                yield pa.RecordBatch.from_arrays([*part[0].columns, part[1]], names=[*part[0].schema.names, "made"])

    return renamed(plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("made", kind)])), docs, **{name: "made"})


def _nulls(valid: np.ndarray) -> pa.Buffer | None:
    return None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())


def _encode_parts(model, batch, column):
    for part in tn.chunks(batch, column, most_bytes=TEXT_BYTES):
        texts = part.column(column)
        ids, bounds = encode(model, texts)
        buffers = [_nulls(texts.is_valid().to_numpy(zero_copy_only=False)), pa.py_buffer(bounds.astype(np.int32).tobytes())]
        yield part, pa.Array.from_buffers(pa.list_(pa.int32()), len(texts), buffers, children=[pa.array(ids)])


def _decode_parts(model, batch, column):
    for i in range(0, batch.num_rows, 500):
        part = batch.slice(i, 500)
        lists = part.column(column)
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(np.where(valid, lists.value_lengths().fill_null(0).to_numpy(), 0)))
        data, offsets = decode(model, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
        yield part, pa.Array.from_buffers(pa.string(), len(lists), [_nulls(valid), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def with_pieces(docs: DataFrame, model_bytes: bytes, text_col: str = "text", name: str = "pieces") -> DataFrame:
    """`docs` with the piece ids of each whole text as array<int> added; no shuffle."""
    return _mapped(docs, text_col, name, T.ArrayType(T.IntegerType()), model_bytes, _encode_parts)


def with_decoded(docs: DataFrame, model_bytes: bytes, pieces_col: str = "pieces", name: str = "decoded") -> DataFrame:
    """`docs` with the text of each array of piece ids added; no shuffle."""
    return _mapped(docs, pieces_col, name, T.StringType(), model_bytes, _decode_parts)
