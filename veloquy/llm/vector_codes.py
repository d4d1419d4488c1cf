"""Compression of vectors to codes: one codebook for each of several equal parts of a vector.

Components become integers, floor(scale * x), so that all sums are exact and the result does not
depend on where rows stand. Each round broadcasts a kd-tree for each codebook (parts x entries,
a bound that does not grow with the data); tasks search it for the nearest entry of every part,
all queries of a batch going down the tree together, and return one integer sum and count for
each part and entry, which Spark adds up. The driver holds these few sums only.

The search goes first to the side of a node where the query lies, then to the other side if that
can hold an entry as near as the best so far. Equal bounds are visited too, so of entries at equal
distance the one of least index is found, as a search over all of them in order would.

Vectors are dropped if null or with null, infinite or NaN components. Defined results: vectors of
different lengths, or of a length that the parts don't divide, count as filled up with zeros behind
their end (to the greatest length, rounded up). Codebooks start from the least ids, each id once
(of rows that repeat an id, the least vector), null ids last; with fewer ids than entries the
codebooks have that many entries. Repeated rows count as often as they stand there. Rows of the
null label are one group. Components of 2**27 or more after scaling are refused, as their sums
would not be exact. An empty table, or one without usable vectors, gives an empty result. Other
columns are carried along; added columns take the place of those of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, numbered, renamed, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Scaled components stay below this, so that squares and sums over 2**30 rows fit 64 bits.
MOST = 1 << 27
#: Rows whose parts are searched together.
SIDE_BY_SIDE = 8192


@dataclass
class Node:
    """An entry, the dimension that splits the others, and the trees on either side."""

    entry: int
    dim: int
    low: Node | None
    high: Node | None


def kd_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node | None:
    """A tree over the entries of a codebook: the median of the widest dimension, then each half."""
    at = np.arange(len(book)) if entries is None else entries
    if not len(at):
        return None
    dim = int(np.ptp(book[at], axis=0).argmax()) if book.shape[1] else 0
    if book.shape[1]:
        at = at[np.lexsort((at, book[at, dim]))]
    mid = len(at) // 2
    return Node(int(at[mid]), dim, kd_tree(book, at[:mid]), kd_tree(book, at[mid + 1 :]))


def nearest(book: np.ndarray, tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each query, least index among equals."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    index = np.full(len(queries), len(book))

    def visit(node: Node | None, at: np.ndarray) -> None:
        if node is None or not len(at):
            return
        apart = queries[at] - book[node.entry]
        distance = (apart * apart).sum(1)
        better = (distance < best[at]) | ((distance == best[at]) & (node.entry < index[at]))
        best[at[better]], index[at[better]] = distance[better], node.entry
        side = apart[:, node.dim] if book.shape[1] else np.zeros(len(at), np.int64)
        below = side < 0
        visit(node.low, at[below])
        visit(node.high, at[~below])
        reach = side * side <= best[at]
        visit(node.high, at[below & reach])
        visit(node.low, at[~below & reach])

    visit(tree, np.arange(len(queries)))
    return index, best


@dataclass
class Codebooks:
    books: list[np.ndarray]  # by part: entries x components
    scale: int

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))


def integers(docs: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector array<long>) of the rows whose vector can be used."""
    vector = F.col(vector_col).cast("array<double>")
    kept = docs.filter(usable(vector))
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0 * MOST)), F.lit(-2.0 * MOST)))).alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` integers; shorter lists are filled up with zeros."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _searched(column: pa.Array, books: list[np.ndarray], trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts of the rows, index of the nearest entries, distances), some rows at a time."""
    width = sum(b.shape[1] for b in books)
    for i in range(0, len(column), SIDE_BY_SIDE):
        rows = _matrix(column.slice(i, SIDE_BY_SIDE), width)
        cut = rows.reshape(len(rows), len(books), width // len(books))
        found = [nearest(b, t, cut[:, p]) for p, (b, t) in enumerate(zip(books, trees, strict=True))]
        yield cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _first(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the least `entries` ids."""
    ids = [r.id for r in rows.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    named = [i for i in ids if i is not None]
    chosen = F.col("id").isin(named) if named else F.lit(False)
    chosen = chosen | F.col("id").isNull() if None in ids else chosen
    # At most `entries` rows come back.
    least = {r.id: r.vector for r in rows.filter(chosen).groupBy("id").agg(F.min("vector").alias("vector")).collect()}
    return [least[i] for i in ids]


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of `integers` rows; None if there are no rows."""
    size = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    if size.width is None:
        return None
    if (size.most or 0) >= MOST:
        raise ValueError("components are too large for exact sums")
    width = -(-size.width // parts) * parts
    start = np.zeros((0, width), np.int64)
    for vector in _first(rows, entries):
        start = np.vstack([start, np.pad(np.array(vector, np.int64), (0, width - len(vector)))])
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        for part, entry, total, count in _sums(rows, books):
            books[part][entry] = [t // count for t in total]
    return Codebooks(books, scale)


def _sums(rows: DataFrame, books: list[np.ndarray]) -> list[tuple[int, int, list[int], int]]:
    """(part, entry, sums of components, parts assigned) for entries that any part is nearest to."""
    shared = rows.sparkSession.sparkContext.broadcast((books, [kd_tree(b) for b in books]))  # parts x entries, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for cut, index, _ in _searched(batch.column(0), books, trees):
                for p in range(len(books)):
                    np.add.at(total[p], index[:, p], cut[:, p])
                    count[p] += np.bincount(index[:, p], minlength=len(books[p]))
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(np.arange(len(books), dtype=np.int32), [len(b) for b in books]), "entry": np.concatenate([np.arange(len(b), dtype=np.int32) for b in books]),
            "total": pa.array([list(map(int, t)) for x in total for t in x], pa.list_(pa.int64())), "n": np.concatenate(count),
        })

    kind = "part int, entry int, total array<long>, n long"
    width = books[0].shape[1]
    partial = rows.select("vector").mapInArrow(run, kind).filter("n > 0")
    sums = [F.sum(F.element_at("total", i + 1)).alias(f"t{i}") for i in range(width)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # a row for each entry
    return [(r.part, r.entry, [r[f"t{i}"] for i in range(width)], r.n) for r in found]


def with_codes(docs: DataFrame, books: Codebooks, vector_col: str = "embedding", name: str = "code") -> DataFrame:
    """The rows of `docs` whose vector can be used, with struct `name`: code (two hexadecimal digits
    for each part) and error (squared distances to the entries, summed over the parts)."""
    kept = docs.filter(usable(F.col(vector_col).cast("array<double>")))
    plain = numbered(kept)
    at = plain.columns[docs.columns.index(vector_col)]
    found = plain.withColumn("vector", F.transform(F.col(at).cast("array<double>"), lambda x: F.floor(x * books.scale)))
    shared = docs.sparkSession.sparkContext.broadcast((books.books, [kd_tree(b) for b in books.books]))
    kind = T.StructType().add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        for batch in batches:
            codes, errors = [], []
            for _, index, distance in _searched(batch.column("vector"), books, trees):
                codes += [bytes(i).hex() for i in index.astype(np.uint8)]
                errors.append(distance.sum(1))
            struct = pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], names=["code", "error"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], struct], names=[*batch.schema.names[:-1], "made"])

    return renamed(found.mapInArrow(run, T.StructType([*plain.schema, T.StructField("made", kind)])), docs, **{name: "made"})


def compressed(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), one row for each usable vector.
    label_error is the error summed over the rows of equal label: labels are summed up before
    anything moves, and the sums, one row a label, are joined back."""
    spark = docs.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a part's index is two hexadecimal digits: 1 to 256 entries")
    rows = stored(integers(docs, id_col, vector_col, label_col, scale), "vectors")
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    if books is None:
        discard(rows)
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("code string, error long, label_error long, codebooks_sha256 string").fields]))
    whole = Codebooks(books.books, 1)  # the stored vectors are scaled
    coded = stored(with_codes(rows, whole, "vector").select("id", "label", "code.code", "code.error"), "codes")
    discard(rows)
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
