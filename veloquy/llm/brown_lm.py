"""Class-based n-gram language model with exchange clustering.

Every training word used LEAST times or more has a class of its own. The TOP most frequent words
are clustered first, by exchange: each item is moved to the class that raises the likelihood of
class bigrams most, until a pass moves little. The items of this are those words, the end of a
text and SHAPES forms (length, digits, bytes beyond ASCII, final punctuation) that stand for all
other words. Each of the other words used LEAST times or more is then moved from its form's class
to the best one by the same gain, from the classes of all its neighbours in training; this is done
in Spark, and the classes are a column of the word table. Then these words are gone through again:
the HEAD most frequent words now stand with their new classes beside each other, class pairs are
counted anew, and each word moves from where it is to where the gain is greatest. Only rarer and unseen words keep the
class of their form. Transitions are counted anew over all training tokens with these classes.
A text's probability is the product over its tokens of P(class | class before) and P(word | class),
for rare words P(form | class) P(word | form).
Transitions are interpolated with class frequencies by the number of distinct followers
(Witten-Bell); rare words are discounted by D = n1 / (n1 + 2 n2), and what that frees is
the probability of a word unseen in training. Each factor sums to one over the words seen and
one unseen word for each shape.

Word counts cover all training texts and grow with them, so they are never broadcast: texts are
dealt into blocks of about BLOCK_BYTES or BLOCK_ROWS, whichever is less, each block asks for the counts of its distinct words
and classes by an equi-join on the word's 64-bit hash, and turns its texts into classes (a byte a
token) and emissions with the answers. These are stored; transitions are counted and scored from
them. Only the items' tables (their sizes are fixed by TOP, HEAD, SHAPES and CLASSES) go to the driver
and back.

Defined results: null text counts as empty and has the end token alone. Without training texts
all counts are 0; each token then has base score 0 and model score 0. Equal counts are ordered
by hash. Repeated rows (of one id and text) share a block and give repeated results; other columns are not read; an empty table gives
an empty result. Null ids are dealt to a block by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import discard, small_batches, stored

TOP = 1000
#: Uses in training from which a word has a class of its own.
LEAST = 5
#: Uses from which a word is gone through again; few uses would follow chance.
AGAIN = 10
#: Most frequent words whose classes the second round over all words looks at.
HEAD = 65_536
SHAPES = 24
CLASSES = 48
PASSES = 8
#: Bytes of text and rows of a block on average.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 2000
#: Training tokens whose words are placed by one task.
BUCKET_TOKENS = 1_000_000
#: Distinct words held by one task before its counts are passed on.
HELD = 1_500_000
END = np.uint64(0x2545F4914F6CDD1D)


def shapes(w: tn.Words) -> np.ndarray:
    """The form of each word, below SHAPES - 1; the end token has SHAPES - 1."""
    size = w.end - w.start
    kinds = np.zeros(256, np.uint8)
    kinds[48:58] = 1
    kinds[128:] = 2
    kind = kinds[w.data]
    digits = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind == 1, out=digits[1:])
    wide = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind == 2, out=wide[1:])
    last = w.data[w.end - 1] if len(size) else np.zeros(0, np.uint8)
    form = np.searchsorted([4, 8, 13], size, side="left") + 4 * np.isin(last, list(b".,;:!?"))
    form += 8 * (wide[w.end] > wide[w.start])
    return np.where(digits[w.end] > digits[w.start], 16, form)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shapes, bounds by text) of the tokens of each text, its end included."""
    w = tn.words(texts, lower=True)
    n = len(w.ptr) - 1
    bounds = w.ptr + np.arange(n + 1)
    ends = bounds[1:] - 1
    inner = np.ones(int(bounds[-1]), bool)
    inner[ends] = False
    key = np.full(len(inner), END, np.uint64)
    form = np.full(len(inner), SHAPES - 1, np.int64)
    key[inner], form[inner] = w.hashes(), shapes(w)
    return key, form, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, count) over the `text` column; summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts):
            key = np.concatenate([p[0] for p in parts])
            kept, at, back = np.unique(key, return_index=True, return_inverse=True)
            return kept, np.concatenate([p[1] for p in parts])[at], np.bincount(back.reshape(-1), np.concatenate([p[2] for p in parts]), len(kept)).astype(np.int64)

        def out(parts):
            key, form, n = made(parts)
            for i in range(0, len(key), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[j].view(np.int64)), pa.array(form[j].astype(np.int32)), pa.array(n[j])], names=["word", "shape", "count"])

        held, size = [], 0
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                key, form, _ = tokens(part.column("text"))
                kept, at, n = np.unique(key, return_index=True, return_counts=True)
                held.append((kept, form[at], n))
                size += len(kept)
                if size > 2 * HELD:
                    held = [made(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from out(held)
                        held, size = [], 0
        if held:
            yield from out(held)

    partial = docs.select("text").mapInArrow(run, "word long, shape int, count long")
    return partial.groupBy("word").agg(F.max("shape").alias("shape"), F.sum("count").alias("count"))


@dataclass
class Items:
    """Frequent words by hash; other tokens are items by shape."""

    keys: np.ndarray  # sorted

    def __len__(self) -> int:
        return len(self.keys) + SHAPES

    def of(self, key: np.ndarray, form: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return form
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys) + form)


def item_bigrams(docs: DataFrame, items: Items) -> np.ndarray:
    """Counts of item pairs, left to right, the end before each text included."""
    n = len(items)
    end = n - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                key, form, bounds = tokens(part.column("text"))
                item = items.of(key, form)
                before = np.empty_like(item)
                before[1:] = item[:-1]
                before[bounds[:-1]] = end
                pair, times = np.unique(before * n + item, return_counts=True)
                total[pair] += times
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000]), pa.array(total[pair[i : i + 100_000]])], names=["pair", "count"])

    found = docs.select("text").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    table = found.toArrow()  # at most (TOP + SHAPES) ** 2 rows
    out = np.zeros(n * n, np.float64)
    out[table["pair"].to_numpy()] = table["count"].to_numpy()
    return out.reshape(n, n)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """What exchange raises: sum of g log g over class pairs less both margins'."""
    return float(_f(grid).sum() - _f(grid.sum(0)).sum() - _f(grid.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each item."""
    n = len(pairs)
    order = np.argsort(-pairs.sum(0), kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.minimum(np.arange(n), classes - 1) if n <= classes else np.where(np.arange(n) < classes, np.arange(n), np.arange(n) % classes)
    member = np.eye(classes)[cls]
    right, left = pairs @ member, pairs.T @ member  # by item and class of the neighbour
    grid = member.T @ right
    for _ in range(passes):
        moved = 0
        for w in order:
            a, self_count = cls[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= self_count
            c[a] -= self_count
            base = grid.copy()
            base[a, :] -= r
            base[:, a] -= c
            base[a, a] -= self_count
            row, col = base.sum(1), base.sum(0)
            gain = (_f(base + r) - _f(base)).sum(1) + (_f(base + c[:, None]) - _f(base)).sum(0)
            d = np.diagonal(base)
            gain += _f(d + r + c + self_count) + _f(d) - _f(d + r) - _f(d + c)
            gain -= _f(row + r.sum() + self_count) - _f(row) + _f(col + c.sum() + self_count) - _f(col)
            b = int(gain.argmax())
            if b == a or gain[b] <= gain[a] + 1e-9:
                continue
            base[b, :] += r
            base[:, b] += c
            base[b, b] += self_count
            grid = base
            right[:, a] -= pairs[:, w]
            right[:, b] += pairs[:, w]
            left[:, a] -= pairs[w, :]
            left[:, b] += pairs[w, :]
            cls[w] = b
            moved += 1
        if moved <= n // 200:
            break
    return cls


def best_classes(grid: np.ndarray, right: np.ndarray, left: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The class to which moving each word, alone, from `cls` raises the likelihood most.

    `grid`: counts of class pairs, these words' uses included; `right`, `left`: by word and class
    of the token after and before it. Classes without uses take no words: as words are placed each
    for itself, unlike words would meet there.
    """
    n, every = len(cls), np.arange(len(cls))

    def side(grid: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Gain of the cells (class, k) that get the word's uses beside class k, less that of their margin."""
        word, k = own.nonzero()
        cells = grid[:, k].T - np.where((k == cls[word])[:, None], other[word], 0)
        cells[np.arange(len(k)), cls[word]] -= own[word, k]
        cells = np.maximum(cells, 0)
        each = _f(cells + own[word, k][:, None]) - _f(cells)
        gain = np.zeros_like(own)
        full = np.flatnonzero(np.bincount(word, minlength=n))
        if len(full):
            gain[full] = np.add.reduceat(each, np.searchsorted(word, full), axis=0)
        uses = own.sum(1)
        margin = grid.sum(1) - other
        margin[every, cls] -= uses
        margin = np.maximum(margin, 0)
        return gain - _f(margin + uses[:, None]) + _f(margin)

    d = np.broadcast_to(np.diagonal(grid), right.shape).copy()
    d[every, cls] -= (right + left)[every, cls]
    d = np.maximum(d, 0)
    gain = side(grid, right, left) + side(grid.T, left, right) + _f(d + right + left) + _f(d) - _f(d + right) - _f(d + left)
    gain = np.where(grid.sum(0) + grid.sum(1) > 0, gain, -np.inf)
    best = gain.argmax(1)
    return np.where(gain[every, best] > gain[every, cls] + 1e-9, best, cls)


def class_grid(docs: DataFrame, items: Items, cls: np.ndarray) -> np.ndarray:
    """Counts of class pairs, left to right, the end before each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                key, form, bounds = tokens(part.column("text"))
                c = cls[items.of(key, form)]
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[bounds[:-1]] = cls[-1]
                total += np.bincount(before * CLASSES + c, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "count"])

    return _grid(docs.select("text").mapInArrow(run, "pair long, count long"))


def _grid(partial: DataFrame) -> np.ndarray:
    table = partial.groupBy("pair").agg(F.sum("count").alias("count")).toArrow()  # at most CLASSES ** 2 rows
    out = np.zeros(CLASSES * CLASSES)
    out[table["pair"].to_numpy()] = table["count"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def neighbours(docs: DataFrame, items: Items, cls: np.ndarray, fixed: Items, buckets: int) -> DataFrame:
    """(bucket, word, near): the classes before and after each use of the words that are not
    `fixed`, two bytes a use; one row a word and some batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            key, near = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(key, kind="stable")
            kept, at = np.unique(key[order], return_index=True)
            at = np.append(at, len(key))
            data = np.ascontiguousarray(near[order])
            for i in range(0, len(kept), 50_000):
                some = at[i : i + 50_001]
                body = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer((2 * (some - some[0])).astype(np.int32)), pa.py_buffer(data[some[0] : some[-1]])])
                word = kept[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array((word % np.uint64(buckets)).astype(np.int32)), pa.array(word.view(np.int64)), body], names=["bucket", "word", "near"])

        held, size = [], 0
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                key, form, bounds = tokens(part.column("text"))
                item = items.of(key, form)
                c = cls[item].astype(np.uint8)
                around = np.full((len(c), 2), cls[-1], np.uint8)
                around[1:, 0], around[:-1, 1] = c[:-1], c[1:]
                around[bounds[:-1], 0] = cls[-1]
                rest = (fixed.of(key, form) >= len(fixed.keys)) & (form < SHAPES - 1)
                held.append((key[rest], around[rest]))
                size += int(rest.sum())
                if size > 4 * HELD:
                    yield from out(held)
                    held, size = [], 0
        if size:
            yield from out(held)

    return docs.select("text").mapInArrow(run, "bucket int, word long, near binary")


def classed_words(docs: DataFrame, counts: DataFrame, items: Items, cls: np.ndarray, grid: np.ndarray, fixed: Items, fixed_cls: np.ndarray, buckets: int, least: int = LEAST) -> DataFrame:
    """`counts` with the class of each word; -1 where it has that of its shape. Words of `least` uses
    or more that are not `fixed` move from their class among `items` (or their shape's), as `grid`
    has them counted; others keep the class that `counts` has."""

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("word").to_numpy())
        right = right.take(pa.array(order))
        word, form, n = (right.column(x).to_numpy() for x in ("word", "shape", "count"))
        item, own = items.of(word.view(np.uint64), form), fixed.of(word.view(np.uint64), form)
        found = np.where(own < len(fixed.keys), fixed_cls[own], right.column("class").to_numpy())
        placed = np.flatnonzero((own >= len(fixed.keys)) & (form < SHAPES - 1) & (n >= least))
        index = np.full(len(word), -1)
        index[placed] = np.arange(len(placed))
        sides = np.zeros((2, len(placed), CLASSES))
        for batch in left.to_batches():
            at = index[np.searchsorted(word, batch.column("word").to_numpy())]
            near = batch.column("near")
            size = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1] if len(near) else np.zeros(1, np.int32)
            uses = np.frombuffer(near.buffers()[2], np.uint8)[size[0] : size[-1]].reshape(-1, 2) if len(near) else np.zeros((0, 2), np.uint8)
            at = np.repeat(at, np.diff(size) // 2)
            for k in (0, 1):
                cell = at[at >= 0] * CLASSES + uses[at >= 0, k]
                sides[k] += np.bincount(cell, minlength=len(placed) * CLASSES).reshape(-1, CLASSES)
        for i in range(0, len(placed), 2000):
            some = placed[i : i + 2000]
            found[some] = best_classes(grid, sides[1, i : i + 2000], sides[0, i : i + 2000], cls[item[some]])
        return pa.table({"word": word, "shape": form, "count": n, "class": found.astype(np.int32)})

    near = neighbours(docs, items, cls, fixed, buckets)
    # The bucket of a hash as unsigned number, as in `neighbours`.
    held = counts if "class" in counts.columns else counts.withColumn("class", F.lit(-1))
    dealt = held.withColumn("bucket", F.expr(f"cast((cast(word as decimal(20, 0)) + if(word < 0, 18446744073709551616BD, 0BD)) % {buckets} as int)"))
    return near.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(place, "word long, shape int, count long, class int")


def transitions(grid: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    freq = (grid.sum(0) + 0.5) / (grid.sum() + 0.5 * CLASSES)
    kinds = (grid > 0).sum(1, keepdims=True) + 1.0
    return np.log10((grid + kinds * freq) / (grid.sum(1, keepdims=True) + kinds))


@dataclass
class BrownModel:
    items: Items
    cls: np.ndarray
    follow: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(item | its class)
    class_tokens: np.ndarray
    shape_tokens: np.ndarray
    discount: np.ndarray
    unseen: np.ndarray  # log10 P(unseen | shape)
    n_tokens: int
    n_words: int

    def emissions(self, key: np.ndarray, form: np.ndarray, count: np.ndarray, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token and log10 P(token | class); `placed`: its class in the word table, or -1."""
        shape = len(self.items.keys) + form
        c = np.where(placed >= 0, placed, self.cls[shape])
        if not self.n_tokens:
            return c, np.zeros(len(key))
        seen = np.log10(np.maximum(count - self.discount[form], 1e-9) / np.maximum(self.shape_tokens[form], 1))
        rare = self.emit[shape] + np.where(form < SHAPES - 1, np.where(count > 0, seen, self.unseen[form]), 0.0)
        return c, np.where(placed >= 0, np.log10(np.maximum(count, 1) / self.class_tokens[c]), rare)


def fit_brown(pairs: np.ndarray, items: Items, by_shape: np.ndarray, n_tokens: int, n_words: int, cls: np.ndarray | None = None, by_class: np.ndarray | None = None) -> BrownModel:
    """`by_shape`: tokens, words, words seen once, twice of each shape outside the words with classes
    of their own; `by_class`: tokens of those words by class. Without it they are the items'."""
    cls = exchange(pairs) if cls is None else cls
    member = np.eye(CLASSES)[cls]
    tokens_, words_, once, twice = by_shape
    item_count = pairs.sum(0) + 0.01
    if by_class is None:
        class_tokens = member.T @ item_count
    else:
        item_count[len(items.keys) :] = tokens_ + 0.01
        class_tokens = by_class + member[len(items.keys) :].T @ item_count[len(items.keys) :]
    emit = np.log10(item_count / np.maximum(class_tokens, 1e-9)[cls])
    discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
    discount = np.clip(discount, 0.05, 0.95)
    unseen = np.log10(np.where(tokens_ > 0, discount * np.maximum(words_, 1) / np.maximum(tokens_, 1), 1.0))
    return BrownModel(items, cls, transitions(member.T @ pairs @ member), emit, class_tokens, tokens_, discount, unseen, n_tokens, n_words)


def _steps(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, bounds by text) of the tokens of stored texts."""
    size = batch.column("n_tokens").to_numpy()
    bounds = np.append(0, np.cumsum(size))
    c = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[bounds[:-1]] = end
    return before, c, bounds


def class_bigrams(coded: DataFrame, end: int) -> np.ndarray:
    """Counts of class pairs over stored texts, left to right, the end before each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            before, c, _ = _steps(batch, end)
            total += np.bincount(before * CLASSES + c, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "count"])

    return _grid(coded.select("n_tokens", "classes").mapInArrow(run, "pair long, count long"))


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def brown_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of `docs`; the model learns from those where `held_out` is false."""
    spark = docs.sparkSession
    plain = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    train = plain.filter(~F.col("held_out"))
    counts = stored(word_counts(train), "word-counts")
    n_tokens, n_words = (int(x or 0) for x in counts.agg(F.sum("count"), F.count("*")).first())
    end = int(np.array([END]).view(np.int64)[0])
    top = [r.word for r in counts.filter(F.col("word") != end).orderBy(F.desc("count"), "word").limit(TOP).collect()]
    items = Items(np.sort(np.array(top, np.int64).view(np.uint64)))
    pairs = item_bigrams(train, items)
    cls = exchange(pairs)
    member, buckets = np.eye(CLASSES)[cls], max(1, n_tokens // BUCKET_TOKENS)
    once = stored(classed_words(train, counts, items, cls, member.T @ pairs @ member, items, cls, buckets), "words-once")
    head = once.filter((F.col("class") >= 0) & (F.col("word") != end)).orderBy(F.desc("count"), "word").limit(HEAD).select("word", "class").toArrow()  # HEAD rows at most
    key, of = head["word"].to_numpy().view(np.uint64), head["class"].to_numpy()
    order = np.argsort(key)
    wide, wide_cls = Items(key[order]), np.concatenate([of[order], cls[len(items.keys) :]])
    words = stored(classed_words(train, once, wide, wide_cls, class_grid(train, wide, wide_cls), items, cls, buckets, AGAIN), "words")
    discard(counts, once)
    n = F.col("count")
    of_shape = words.filter("class < 0").groupBy("shape").agg(F.sum("count").alias("t"), F.count("*").alias("w"), F.count(F.when(n == 1, 1)).alias("o"), F.count(F.when(n == 2, 1)).alias("b"))
    by_shape, by_class = np.zeros((4, SHAPES)), np.zeros(CLASSES)
    for r in of_shape.collect():
        by_shape[:, r["shape"]] = r.t, r.w, r.o, r.b
    for r in words.filter("class >= 0").groupBy("class").agg(F.sum("count").alias("t")).collect():
        by_class[r["class"]] = r.t
    model = fit_brown(pairs, items, by_shape, n_tokens, n_words, cls, by_class)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by TOP, SHAPES and CLASSES

    whole = plain.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-whole["rows"] // block_rows), -(-whole["bytes"] // BLOCK_BYTES))
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def wanted(table: pa.Table) -> pa.Table:
        found = [np.unique(tokens(part.column("text"))[0]) for batch in table.combine_chunks().to_batches() for part in tn.chunks(batch, "text")]
        key = np.unique(np.concatenate(found))
        return pa.table({"block": pa.array(np.full(len(key), table.column("block")[0].as_py(), np.int32)), "word": pa.array(key.view(np.int64))})

    asked = dealt.groupBy("block").applyInArrow(wanted, "block int, word long")
    answers = asked.join(words.select("word", "count", "class"), "word").select("block", "word", "count", "class")

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value
        key_of = right.column("word").to_numpy().view(np.uint64)
        order = np.argsort(key_of)
        known, times, classes = np.append(key_of[order], np.uint64(0)), np.append(right.column("count").to_numpy()[order], 0), np.append(right.column("class").to_numpy()[order], -1)
        out = []
        for batch in left.combine_chunks().to_batches():
            for part in tn.chunks(batch, "text"):
                key, form, bounds = tokens(part.column("text"))
                at = np.searchsorted(known[:-1], key)
                found = (at < len(known) - 1) & (known[at] == key)
                count, placed = np.where(found, times[at], 0), np.where(found, classes[at], -1)
                base = tn.sums(np.log10((count + 1.0) / (model.n_tokens + model.n_words + 1)), bounds)
                c, emission = model.emissions(key, form, count, placed)
                body = c.astype(np.uint8).tobytes()
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), pa.array(tn.sums(count > 0, bounds)), pa.array(base), pa.array(tn.sums(emission, bounds)), pa.array([body[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())]
                out.append(pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CODED.split(", ")]))
        return pa.Table.from_batches(out)

    coded = stored(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(code, CODED), "coded-texts")
    discard(words)
    end_class = int(cls[-1])
    follow = transitions(class_bigrams(coded.filter(~F.col("held_out")), end_class)) if n_tokens else np.zeros((CLASSES, CLASSES))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, c, bounds = _steps(batch, end_class)
            size = np.diff(bounds)
            score = batch.column("emission").to_numpy() + tn.sums(follow[before, c], bounds)
            columns = [*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(size), n_tokens)), batch.column("base_score"), pa.array(score), pa.array(10 ** np.minimum(-score / size, 300))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return coded.mapInArrow(scored, RESULT)
