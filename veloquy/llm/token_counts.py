"""Token counts at every prefix of a text, by dynamic programming over the merges of a BPE file.

A tokenizer file (JSON, BPE with word ends) is read once. Texts are normalised and cut into words
as the file says; distinct words of one length advance together in numpy. Merging has a property
that makes counts additive: tokens are what merging a text gives exactly if each is what its own
bytes merge to and no two neighbours would have merged otherwise (`_neighbours_hold`). So every
prefix of a word has one last token, the one that may stand behind the last token of what is
before it, and its count is one more than that prefix's. Each prefix of a word is counted twice:
open (the word goes on) and closed (it ends there, as in a text that is cut there). A text's count
at a prefix is the counts of its whole words before plus the closed count inside the word.

`with_prefix_counts` stores the array, from which `tokens_in` and `longest_within` answer any
question about truncation or a budget; `with_budget` answers one for each text and keeps no array.
Prefixes are counted in code points of the text as it is. Where a prefix ends inside something that
reads otherwise when it is cut (base and combining marks, special strings, 're 've 'll), the few
code points from the word before are counted by the library.

Special strings of the file count as one token each, as the library does by default; no begin, end,
truncation or padding. Files with other normalisers, cuts or settings are refused.

Defined results: null and empty texts have no tokens and one prefix, of count 0. Very long texts are worked
on whole, in sections that begin behind white space. Texts are counted one by one: repeated rows,
ties and other columns change nothing, but added columns take the place of those of their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import numbered, renamed

# What a file has to say to be read here.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

SPACE, LETTER, NUMBER, OTHER = range(4)
POINTS = 0x110000
#: Code points from here on are in planes without letters, numbers or spaces.
LATER_PLANES = 0x40000
SIEVE_BITS = 20
#: Pairs of neighbours whose verdict a task remembers, as a power of two.
MEMO_BITS = 18
#: Distinct words, and bytes of them, that a task remembers from chunk to chunk.
MEMO_WORDS, MEMO_BYTES = 300_000, 3_000_000
#: Words of one length that advance together.
SIDE_BY_SIDE = 20_000
#: Code points of texts that are worked on together; longer texts are cut into sections of about that.
SECTION = 1 << 19


@dataclass
class Table:
    """Tokens by the hash of their bytes."""

    keys: np.ndarray  # sorted
    tokens: np.ndarray
    sieve: np.ndarray  # whether any key begins with these SIEVE_BITS

    @classmethod
    def of(cls, texts: list[bytes], tokens: list[int]) -> Table:
        size = np.array([len(t) for t in texts], np.int64)
        data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
        keys = tn.spans(tn.prefix(tn._BYTE_VALUE[data]), end - size, end)
        order = np.argsort(keys)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        return cls(keys[order], np.array(tokens, np.int64)[order], sieve)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, token) of the hashes in `key` that are a token's."""
        row, col = np.nonzero(self.sieve[(key >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        some = key[row, col]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        same = self.keys[at] == some
        return row[same], col[same], self.tokens[at[same]]


@dataclass
class Counter:
    source: str  # the file's text, for the library
    open: Table
    closed: Table
    longest: int  # bytes
    pair_keys: np.ndarray  # sorted left * size + right of all merges
    pair_ranks: np.ndarray
    rank: np.ndarray  # of the merge that makes a token, -1 for single bytes
    left: np.ndarray
    right: np.ndarray
    specials: list[str]
    lower: np.ndarray  # by code point: what it is normalised to
    kind: np.ndarray  # by code point: SPACE, LETTER, NUMBER, OTHER
    joins: np.ndarray  # by code point: may change with the one before
    grows: np.ndarray  # by code point: normalised to several
    memo: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.full(1 << MEMO_BITS, -1), np.zeros(1 << MEMO_BITS, bool)))
    words: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level files: printable bytes for themselves, the
    others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _made_of(parts: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """`parts` merged until two are left, or as far as it goes."""
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), (1 << 60,))[0])
        found = ranks.get((parts[best], parts[best + 1]))
        if found is None:
            return parts
        parts[best : best + 2] = [found[1]]
    return parts


def parse_counter(data: bytes) -> Counter:
    from tokenizers import Tokenizer

    text = data.decode()
    said = json.loads(text)
    model = said["model"]
    suffix = model.get("end_of_word_suffix") or ""
    cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    known = (said.get("normalizer") or {}).get("normalizers") == NORMALIZERS and model["type"] == "BPE" and bool(suffix)
    known &= len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": CUT} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    if not known or odd or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in said["added_tokens"]):
        raise ValueError("the file normalises, cuts or merges texts in a way that is not known here")
    letters = byte_letters()
    names = list(model["vocab"])
    number = {t: i for i, t in enumerate(names)}
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for i, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        ranks[number[a], number[b]] = (i, number[a + b])
    rank, left, right = (np.full(len(names), -1) for _ in range(3))
    spelled: dict[bool, tuple[list[bytes], list[int]]] = {False: ([], []), True: ([], [])}
    for token, name in enumerate(names):
        ends = name.endswith(suffix)
        body = name.removesuffix(suffix) if ends else name
        if not body or any(c not in letters for c in body):
            continue
        parts = _made_of([number.get(c + suffix * (ends and i == len(body) - 1), -1) for i, c in enumerate(body)], ranks)
        if len(parts) == 2 and ranks.get((parts[0], parts[1]), (0, -1))[1] == token:
            left[token], right[token], rank[token] = *parts, ranks[parts[0], parts[1]][0]
        elif len(body) > 1:
            continue  # merging never ends in it
        spelled[ends][0].append(bytes(letters[c] for c in body))
        spelled[ends][1].append(token)
    if min(len([t for t in spelled[e][0] if len(t) == 1]) for e in spelled) < 256:
        raise ValueError("the file has no token for some bytes")
    keys = np.array([a * len(names) + b for a, b in ranks], np.int64)
    order = np.argsort(keys)
    library = Tokenizer.from_str(text)
    lower, kind, joins, grows = _code_points(library)
    longest = max(len(t) for e in spelled for t in spelled[e][0])
    specials = sorted((a["content"] for a in said["added_tokens"]), key=len, reverse=True)
    return Counter(text, Table.of(*spelled[False]), Table.of(*spelled[True]), longest, keys[order], np.array([r for r, _ in ranks.values()])[order], rank, left, right, specials, lower, kind, joins, grows)


def _code_points(library) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower, kind, joins, grows) by code point, as the library's own normaliser and cut say."""
    lower, kind = np.arange(POINTS, dtype=np.uint32), np.full(POINTS, OTHER, np.uint8)
    joins, grows = np.zeros(POINTS, bool), np.zeros(POINTS, bool)
    joins[0x1161:0x1176] = joins[0x11A8:0x11C3] = True
    for c in range(1, LATER_PLANES):
        # Those that Python does not know yet may be marks to the library.
        if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cn"):
            joins[c] = True
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<" and len(two := parts.split()) == 2:
            joins[int(two[1], 16)] = True
    for begin in range(1, LATER_PLANES, 0x2000):
        some = [c for c in range(begin, min(begin + 0x2000, LATER_PLANES)) if not 0xD800 <= c < 0xE000]
        if not some:
            continue
        for c, made in zip(some, library.normalizer.normalize_str("\0".join(map(chr, some))).split("\0"), strict=True):
            if len(made) == 1:
                lower[c] = ord(made)
            else:
                grows[c] = True
        # "ca" and "c!" stay together for letters and others only; a space leaves one piece.
        for tail, of in (("a", LETTER), ("!", OTHER)):
            pieces: dict[int, list[int]] = {}
            for _, (a, b) in library.pre_tokenizer.pre_tokenize_str("".join(f"{chr(c)}{tail} " for c in some)):
                pieces.setdefault(a // 3, []).append(b - a)
            for i, c in enumerate(some):
                if pieces[i] == [2]:
                    kind[c] = of
                elif len(pieces[i]) == 1:
                    kind[c] = SPACE
                elif of == OTHER and kind[c] != LETTER:
                    kind[c] = NUMBER
    return lower, kind, joins, grows


def _neighbours_hold(model: Counter, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the bytes of tokens `a` and `b` ends in just these two. Their merges are
    undone from the last on; at no time may the two parts that meet have a merge that comes first."""
    hold = np.ones(len(a), bool)
    at, limit = np.arange(len(a)), np.full(len(a), len(model.pair_keys))
    a, b = a.copy(), b.copy()
    while len(at):
        pair = a * len(model.rank) + b
        place = np.minimum(np.searchsorted(model.pair_keys, pair), len(model.pair_keys) - 1)
        broken = (model.pair_keys[place] == pair) & (model.pair_ranks[place] < limit)
        hold[at[broken]] = False
        go = ~broken & ((model.rank[a] >= 0) | (model.rank[b] >= 0))
        at, a, b = at[go], a[go], b[go]
        by_a = model.rank[a] > model.rank[b]
        limit = np.where(by_a, model.rank[a], model.rank[b] + 1)
        a, b = np.where(by_a, model.right[a], a), np.where(by_a, b, model.left[b])
    return hold


def _holds(model: Counter, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`_neighbours_hold`, computed once for pairs met lately; nothing (-1) may stand before any."""
    out = a < 0
    some = np.flatnonzero(~out)
    pair = a[some] * len(model.rank) + b[some]
    slot = (tn.mix64(pair.astype(np.uint64)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
    known, verdict = model.memo
    out[some] = verdict[slot]
    new = np.flatnonzero(known[slot] != pair)
    if len(new):
        one, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
        made = _neighbours_hold(model, a[some[new[first]]], b[some[new[first]]])
        out[some[new]] = made[back.reshape(-1)]
        place, keep = np.unique(slot[new[first]], return_index=True)
        known[place], verdict[place] = one[keep], made[keep]
    return out


def _closed_counts(model: Counter, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word data[start:end] and each of its prefixes, the tokens of that prefix as a word."""
    size = end - start
    begin = np.cumsum(size) - size
    flat = data[np.repeat(start - begin, size) + np.arange(int(size.sum()))]
    sums = tn.prefix(tn._BYTE_VALUE[flat])
    out = np.zeros(len(flat), np.int32)
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        most = max(1, min(SIDE_BY_SIDE, 4_000_000 // (int(n) * min(int(n), model.longest))))
        for i in range(0, len(same), most):
            at = begin[same[i : i + most]]
            count = np.zeros((len(at), n + 1), np.int32)
            last = np.full((len(at), n + 1), -1)
            for stop in range(1, n + 1):
                starts = np.arange(max(0, stop - model.longest), stop)
                key = tn.spans(sums, at[:, None] + starts, at[:, None] + np.array([stop]))
                row, col, token = model.closed.find(key)
                ok = _holds(model, last[row, starts[col]], token)
                out[at[row[ok]] + stop - 1] = count[row[ok], starts[col[ok]]] + 1
                if stop < n:
                    row, col, token = model.open.find(key)
                    ok = _holds(model, last[row, starts[col]], token)
                    row, col = row[ok], starts[col[ok]]
                    count[row, stop] = count[row, col] + 1
                    last[row, stop] = token[ok]
    return out


def _known_words(model: Counter, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, counts): counts of the prefixes of distinct words data[start:end] of sorted hashes
    `key` are counts[where[i]:]; only words that the chunks before have not had are worked on."""
    keys, begins, held = model.words
    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    seen = keys[at] == key if len(keys) else np.zeros(len(key), bool)
    new = np.flatnonzero(~seen)
    size = end - start
    fresh = _closed_counts(model, data, start[new], end[new])
    where = np.empty(len(key), np.int64)
    where[seen] = begins[at[seen]]
    where[new] = len(held) + np.cumsum(size[new]) - size[new]
    counts = np.concatenate([held, fresh])
    if len(keys) + len(new) <= MEMO_WORDS and len(counts) <= MEMO_BYTES:
        order = np.argsort(np.concatenate([keys, key[new]]), kind="stable")
        model.words = (np.concatenate([keys, key[new]])[order], np.concatenate([begins, where[new]])[order], counts)
    elif len(keys):
        model.words = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))  # anew from the next chunk's
    return where, counts


@lru_cache(maxsize=1)
def _library(source: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


@lru_cache(maxsize=100_000)
def _by_library(source: str, text: str) -> int:
    return len(_library(source).encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=100_000)
def _normalised(source: str, text: str) -> str:
    return _library(source).normalizer.normalize_str(text)


def _word_bounds(model: Counter, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, cuts): the words, and places inside a word where a text that ends there has two."""
    n = len(norm)
    kind = np.append(model.kind[norm], SPACE)
    begin = np.ones(n + 1, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= kind == NUMBER
    at = np.flatnonzero((norm == 39) & begin[:n] & (kind[1:] == LETTER))
    padded = np.append(norm, [0, 0, 0])
    one = np.isin(padded[at + 1], [ord(c) for c in ONE_LETTER])
    two = np.zeros(len(at), bool)
    for x, y in TWO_LETTERS:
        two |= (padded[at + 1] == ord(x)) & (padded[at + 2] == ord(y))
    for hit, length in ((at[one], 1), (at[two & ~one], 2)):
        begin[hit + 1] = False
        begin[hit + 1 + length] = True
    start = np.flatnonzero(begin & (kind != SPACE))
    border = np.flatnonzero(begin | (kind == SPACE))
    end = border[np.searchsorted(border, start, side="right")] if len(start) else start
    return start, end, at[two & ~one] + 2


def section_counts(model: Counter, text: str) -> np.ndarray:
    """Tokens of text[:k] for k from 0 to its length; `text` may be several, with new lines between."""
    plain, special_ends, inner = text, [], []
    if any(s in text for s in model.specials):
        for hit in re.finditer("|".join(map(re.escape, model.specials)), text):
            special_ends.append(hit.end())
            inner += [(k, hit.start()) for k in range(hit.start() + 1, hit.end())]
        plain = re.sub("|".join(map(re.escape, model.specials)), lambda hit: "\n" * len(hit[0]), text)
    point = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    n = len(point)
    norm, width = model.lower[point], np.ones(n, np.int64)
    joins = model.joins[point]
    joins[:1] = False
    odd = np.flatnonzero(joins | model.grows[point])
    if len(odd):
        base = np.maximum.accumulate(np.where(joins, 0, np.arange(n)))[odd]
        first = np.unique(base + (model.kind[norm[base]] == SPACE))  # marks don't join a space
        stop = np.append(np.flatnonzero(~joins), n)
        last = stop[np.searchsorted(stop, first, side="right")]
        parts, at = [], 0
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            made = np.frombuffer(_normalised(model.source, plain[i:j]).encode("utf-32-le"), np.uint32)
            parts += [norm[at:i], made]
            width[i:j] = 0
            width[i] = len(made)
            inner += [(k, i) for k in range(i + 1, j)]
            at = j
        norm = np.concatenate([*parts, norm[at:]])
    place = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=place[1:])
    start, end, cuts = _word_bounds(model, norm)
    octets = 1 + (norm >= 0x80) + (norm >= 0x800).astype(np.int64) + (norm >= 0x10000)
    byte = np.zeros(len(norm) + 1, np.int64)
    np.cumsum(octets, out=byte[1:])
    data = np.frombuffer(norm.tobytes().decode("utf-32-le").encode(), np.uint8)
    key = tn.spans(tn.prefix(tn._BYTE_VALUE[data]), byte[start], byte[end])
    key, one, number = np.unique(key, return_index=True, return_inverse=True)
    number = number.reshape(-1)
    where, counts = _known_words(model, key, data, byte[start[one]], byte[end[one]])
    whole = counts[where[number] + byte[end] - byte[start] - 1] if len(start) else np.zeros(0, np.int32)
    before = np.zeros(len(start) + 1, np.int64)
    np.cumsum(whole, out=before[1:])
    # At the end of each normalised code point: the words before its own, and its own so far.
    of = np.searchsorted(start, np.arange(len(norm)), side="right") - 1
    inside = np.zeros(len(norm), bool)
    if len(start):
        inside = (of >= 0) & (np.arange(len(norm)) < end[np.maximum(of, 0)])
    made = before[of + 1]
    own = of[inside]
    made[inside] = before[own] + counts[where[number[own]] + byte[1:][inside] - byte[start[own]] - 1]
    out = np.append(0, made)[place]
    for k in special_ends:
        out[k:] += 1
    inner += [(int(k), int(k) - 2) for k in np.searchsorted(place, cuts)]
    for k, i in inner:
        # From the start of the word before that which holds code point i, if nothing stands between
        # and it starts with a code point of the text, not in the middle of what one was made to.
        word = int(np.searchsorted(start, place[i], side="right")) - 1
        from_ = i
        if word >= 0 and place[i] <= end[word]:
            word -= bool(word and end[word - 1] == start[word] and place[i] < end[word])
            from_ = int(np.searchsorted(place, start[word], side="right")) - 1
            while word and place[from_] != start[word]:
                word -= 1
                from_ = int(np.searchsorted(place, start[word], side="right")) - 1
        out[k] = out[from_] + _by_library(model.source, text[from_:k])
    return out


def prefix_counts(model: Counter, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The counts at all prefixes of each text, in order."""
    held: list[str] = []

    def flush() -> Iterator[np.ndarray]:
        found = section_counts(model, "\n".join(held)) if held else None
        at = 0
        for text in held:
            yield found[at : at + len(text) + 1] - found[at]
            at += len(text) + 1
        held.clear()

    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > SECTION:
            yield from flush()
            size = 0
        if len(text) <= SECTION:
            held.append(text)
            size += len(text) + 1
            continue
        parts, at, total = [np.zeros(1, np.int64)], 0, 0
        space = re.compile(r"[ \n\t](?=[0-9A-Za-z])")
        while at < len(text):
            hit = space.search(text, at + SECTION)
            stop = hit.end() if hit else len(text)
            parts.append(section_counts(model, text[at:stop])[1:] + total)
            total, at = int(parts[-1][-1]), stop
        yield np.concatenate(parts)
    yield from flush()


def longest_prefix(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most `limit` tokens."""
    return int(np.flatnonzero(counts <= limit)[-1])


def _mapped(docs: DataFrame, text_col: str, kind: T.DataType, file: bytes, work) -> DataFrame:
    plain = numbered(docs)
    at = plain.columns[docs.columns.index(text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(parse_counter(file))  # one tokenizer file and tables by code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tn.chunks(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, work(prefix_counts(model, part.column(at).to_pylist()))], names=[*part.schema.names, "made"])

    return plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("made", kind)]))


def with_prefix_counts(docs: DataFrame, file: bytes, text_col: str = "text", name: str = "prefix_tokens") -> DataFrame:
    """`docs` with array<int> `name`: element k (from 0) is the token count of the first k code
    points of the whole text. No shuffle."""
    found = _mapped(docs, text_col, T.ArrayType(T.IntegerType()), file, lambda each: pa.array([c.astype(np.int32) for c in each], pa.list_(pa.int32())))
    return renamed(found, docs, **{name: "made"})


def with_budget(docs: DataFrame, file: bytes, limit: int, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """`docs` with struct `name`: n_tokens of the whole text, and fits, the code points of its
    longest prefix of at most `limit` tokens. No shuffle, and no array leaves the task."""
    if limit < 0:
        raise ValueError("a budget is not negative")

    def work(each: Iterator[np.ndarray]) -> pa.Array:
        found = [(int(c[-1]), longest_prefix(c, limit)) for c in each]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["n_tokens", "fits"])

    return renamed(_mapped(docs, text_col, T.StructType().add("n_tokens", "long").add("fits", "long"), file, work), docs, **{name: "made"})


def tokens_in(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first `n_chars` code points, from stored counts."""
    return F.element_at(counts, F.least(F.greatest(n_chars, F.lit(0)) + 1, F.size(counts)).cast("int"))


def longest_within(counts: Column, limit: Column) -> Column:
    """Code points of the longest prefix of at most `limit` tokens, from stored counts."""
    fitting = F.transform(counts, lambda c, i: F.when(c <= limit, i))
    return F.array_max(fitting)
