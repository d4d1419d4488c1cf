"""A search index kept up to date file by file: immutable segments, deletions, block maxima, phrases.

An index is a folder. Each `update` compares the files there are (path, stamp) with those it holds,
writes one segment of the rows of new and changed files, and one list of (segment, path) that are
gone from older segments; nothing that was written before is changed. What is valid is said by a
manifest, one small table for each version, written last: readers take the greatest version that
is complete, so a writer that stops at any point leaves the old state readable, and what it had
written is never looked at. `compact` writes all live rows as one segment.

Statistics add up: a segment has the number of rows of each of its terms, number and length of
its rows; a deletion has the same of the rows it takes away, and counts as minus. So scores are
those of `search.bm25` over the live rows, whatever the history.

A segment's tables, of which `texts` is made first and the others from it:

- `texts`: the rows as they were read, each task's sorted by length in a file of its own. Rows get their
  place there: `block`, some BLOCK_ROWS that stand together, and `row` in it. So no text is ever shuffled,
  and the lists of a block are made where it is read.
- `rows` (key, path, stamp, block, row, length, metadata), for searches that need no text.
- `postings`: one row a term and block, with the rows of the block that hold the term and how often
  (`fs`); keys and metadata are looked up in `rows`. Beside them stand the greatest f and the least
  length, which bound what any row can score. A block that two tasks read has two such rows.
- `grams`: for each three characters the rows that hold them, by block; every character of a text
  starts one (cut short at the end), so phrases of one or two characters are found as beginnings.

Postings and grams are in folders by a hash of what they are searched by, texts by the task that
wrote them. Document frequencies are sums over postings, less those of a deletion (`terms`); of a term
that was looked up once it is remembered.

A search scores all postings of its terms in one job, or, where these are more than DIRECT, first
the bounds of the blocks alone: the blocks of the greatest bounds are scored, the k-th score found
is a threshold, and only blocks whose bound reaches it have their entries read. Hits and scores
are the same either way. Phrases are literal, as in the text, case and punctuation included.

Defined results: rows without key are refused, as are keys that repeat; null text has no terms and
no phrases; columns of any name are possible, as key, path and metadata are held under names of
the index's own. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloquy.functions import lists
from veloquy.functions.query import Query
from veloquy.functions.text import once, regex_tokens
from veloquy.operators.search import B, K1, saturated, top
from veloquy.session import small_batches

BUCKETS = 32
#: Rows of a block; a row's place in it is a byte.
BLOCK_ROWS = 128
#: Text of a block in bytes, where rows are so long that fewer make a block.
BLOCK_BYTES = 1 << 24
#: Bytes that a file's row group of texts has about; tasks read whole ones.
TEXT_GROUP = 1 << 24
#: Bits of a block's number within the task that wrote it.
TASK_BITS = 33
#: Postings of a query's terms up to which their blocks' bounds are not looked at.
DIRECT = 2_000_000
#: Rows whose texts are asked for by their keys; more are joined.
BY_KEY = 5_000
GRAM = 3
MANIFEST = T.StructType().add("part", "string").add("minus", "boolean").add("rows", "long").add("length", "long").add("key", "string").add("schema", "string")


def _bucket(value: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(value) % buckets).cast("int")


def _buckets_of(values: list[str]) -> list[int]:
    return sorted({zlib.crc32(v.encode()) % BUCKETS for v in values})


@dataclass
class SegmentIndex:
    """One version of an index; nothing that is written later changes it."""

    spark: SparkSession
    path: str
    version: int
    key: str = ""
    schema: T.StructType | None = None  # key, path, stamp, meta as they are held
    segments: list[str] = field(default_factory=list)
    minus: list[str] = field(default_factory=list)
    n: int = 0
    length: int = 0
    df: dict[str, int] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def mean_length(self) -> float:
        return self.length / self.n if self.n else 1.0

    def table(self, name: str) -> DataFrame:
        """A table of all valid parts, with the part as column `part`."""
        if name not in self.tables:
            base = f"{self.path}/{name}"
            parts = self.minus if name in ("deleted", "terms") else self.segments
            schema = self._schemas()[name]
            empty = self.spark.createDataFrame([], schema)
            found = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/part={p}" for p in parts]) if parts else empty
            self.tables[name] = found
        return self.tables[name]

    def _schemas(self) -> dict[str, T.StructType]:
        key, path, stamp, meta = (self.schema[c].dataType for c in ("key", "path", "stamp", "meta"))
        rows = T.ArrayType(T.ByteType())
        place = T.StructType().add("key", key).add("path", path).add("stamp", stamp).add("block", "long").add("row", "byte").add("length", "integer").add("meta", meta)
        made = {
            "postings": T.StructType().add("term", "string").add("block", "long").add("n", "long").add("max_f", "integer").add("min_length", "integer").add("rows", rows).add("fs", T.ArrayType(T.IntegerType())),
            "terms": T.StructType().add("term", "string").add("df", "long"),
            "grams": T.StructType().add("gram", "string").add("block", "long").add("rows", rows),
            "rows": T.StructType([*place]),
            "texts": T.StructType([*place]).add("text", "string"),
            "deleted": T.StructType().add("segment", "string").add("path", path),
        }
        for name, kind in made.items():
            kind.add("part", "string")
            if name not in ("rows", "deleted"):
                kind.add("bucket", "integer")
        return made

    def live(self, df: DataFrame, path: str = "path") -> DataFrame:
        """Rows of segments without those that were deleted since."""
        if not self.minus:
            return df
        gone = self.table("deleted").select("segment", F.col("path").alias("__gone"))
        return df.join(gone, (F.col("part") == F.col("segment")) & F.col(path).eqNullSafe(F.col("__gone")), "left_anti")

    def document_frequency(self, terms: list[str]) -> dict[str, int]:
        new = [t for t in terms if t not in self.df]
        if new:
            asked = lambda table: self.table(table).filter(F.col("bucket").isin(_buckets_of(new)) & F.col("term").isin(new))
            counts = asked("postings").select("term", F.col("n").alias("df"))
            if self.minus:
                counts = counts.unionAll(asked("terms").select("term", -F.col("df")))
            # One row for each term of the query.
            self.df |= dict.fromkeys(new, 0) | {r.term: r.df for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        return {t: self.df[t] for t in terms}


# ---- versions ---------------------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of an index, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    done = [n for n in names if n.isdigit() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n}/_SUCCESS"))]
    return sorted(map(int, done))


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SegmentIndex:
    """The last complete version (or an older one); version 0 is the empty index before any update."""
    known = _versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return SegmentIndex(spark, path, 0)
    # One row for each part of the index.
    said = spark.read.schema(MANIFEST).json(f"{path}/manifests/{version}").collect()
    sign = lambda r: -1 if r.minus else 1
    return SegmentIndex(
        spark, path, version, said[0].key, T.StructType.fromJson(json.loads(said[0].schema)), [r.part for r in said if not r.minus], [r.part for r in said if r.minus],
        sum(sign(r) * r.rows for r in said), sum(sign(r) * r.length for r in said),
    )


def _commit(spark: SparkSession, path: str, version: int, key: str, schema: T.StructType, parts: list[tuple[str, bool, int, int]]) -> SegmentIndex:
    """Write the manifest of `version`; fails if another writer was faster."""
    rows = [(*p, key, schema.json()) for p in parts]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/{version}")
    return open_index(spark, path, version)


def _parts(index: SegmentIndex) -> list[tuple[str, bool, int, int]]:
    if not index.version:
        return []
    said = index.spark.read.schema(MANIFEST).json(f"{index.path}/manifests/{index.version}").collect()
    return [(r.part, r.minus, r.rows, r.length) for r in said]


# ---- writing ----------------------------------------------------------------------------


def held_rows(rows: DataFrame, key: str, path_col: str, stamp_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    """(key, path, stamp, text, meta) under the index's own names."""
    meta = F.struct(*[F.col(m) for m in metadata]) if metadata else F.struct(F.lit(None).cast("int").alias("none"))
    return rows.select(F.col(key).alias("key"), F.col(path_col).alias("path"), F.col(stamp_col).alias("stamp"), F.col(text_col).cast("string").alias("text"), meta.alias("meta"))


def _write_segment(index: SegmentIndex, part: str, held: DataFrame, tokenizer: Callable[[Column], Column]) -> tuple[int, int]:
    """Write the tables of one segment; its number of rows and their length."""
    spark, base = index.spark, index.path
    to = lambda name: f"{base}/{name}/part={part}"
    # Where a row stands is said once, when texts are written; all else is read from there. A task's
    # rows are numbered in order of length, so no row need move to another task to be among its like.
    fewer = F.floor(F.log2(F.lit(float(BLOCK_BYTES)) / F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1))))
    size = F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(BLOCK_ROWS.bit_length() - 1), fewer))).cast("long")
    task = F.pmod(F.spark_partition_id(), F.lit(BUCKETS))
    sorted_rows = held.withColumn("length", F.size(tokenizer(F.col("text")))).withColumn("bucket", task).sortWithinPartitions("bucket", "length")
    placed = sorted_rows.withColumn("id", F.monotonically_increasing_id()).withColumn("row", F.col("id") % size).withColumn("block", F.col("id") - F.col("row"))
    kept = ["key", "path", "stamp", "block", F.col("row").cast("byte").alias("row"), "length", "meta", "text", "bucket"]
    _written(placed.select(*kept).write.option("parquet.block.size", TEXT_GROUP).partitionBy("bucket"), to("texts"))
    made = small_batches(spark.read.schema(placed.select(*kept).schema).parquet(to("texts")))
    _written(made.select("key", "path", "stamp", "block", "row", "length", "meta").write, to("rows"))
    _write_lists(made.filter("length > 0").select("block", "row", "length", tokenizer(F.col("text")).alias("tokens")).mapInArrow(lists.postings, lists.POSTINGS), to("postings"), "term", "block")
    _write_lists(made.filter(F.octet_length("text") > 0).select("block", "row", "text").mapInArrow(lists.grams, lists.GRAMS), to("grams"), "gram", "block")
    rows = spark.read.schema(made.select("key", "length").schema).parquet(to("rows"))
    total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count("key"), F.countDistinct("key")).first()
    if not total[0] == total[2] == total[3]:
        raise ValueError("keys are null or repeat")
    return total[0], total[1]


def runs(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text, one from each character, cut short at the end:
    what `lists.grams` puts into the index, as a column."""
    # By an array of characters: finding the i-th in a text goes through all before it.
    behind = lambda chars, i, n: F.coalesce(F.get(chars, i + n), F.lit(""))
    return once(F.split(text, "", -1), lambda chars: F.array_distinct(F.transform(chars, lambda c, i: F.concat(c, *[behind(chars, i, n) for n in range(1, GRAM)]))))


def _written(writer: DataFrameWriter, path: str) -> None:
    writer.mode("overwrite").option("compression", "zstd").parquet(path)


def _write_lists(df: DataFrame, path: str, by: str, *also: str) -> None:
    """Write `df` in folders by a hash of `by`, sorted by it (and `also`). Each task writes a file a folder: dealing the
    lists out to tasks would put all of them on disk a second time."""
    _written(df.withColumn("bucket", _bucket(F.col(by))).sortWithinPartitions("bucket", by, *also).write.partitionBy("bucket"), path)


def _write_terms(df: DataFrame, path: str) -> None:
    _write_lists(df, path, "term")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def update(
    spark: SparkSession, path: str, files: DataFrame, read: Callable[[DataFrame], DataFrame], key: str, path_col: str = "path", stamp_col: str = "stamp",
    text_col: str = "text", metadata: tuple[str, ...] = (), tokenizer: Callable[[Column], Column] = regex_tokens, rebuild: bool = False,
) -> SegmentIndex:
    """Bring the index under `path` to the state of `files` (path, stamp), of which those that are
    new or have another stamp are read by `read(files)`: rows with path, stamp, key, text and
    metadata. `rebuild` takes all files for new and keeps no older part. Without a change the version stays."""
    index = open_index(spark, path)
    wanted = files.select(F.col(path_col).alias("path"), F.col(stamp_col).alias("stamp")).distinct()
    same = lambda a, b: F.col(f"{a}.path").eqNullSafe(F.col(f"{b}.path")) & F.col(f"{a}.stamp").eqNullSafe(F.col(f"{b}.stamp"))
    keep = index.version and not rebuild
    if keep:
        known = index.live(index.table("rows")).select("part", "path", "stamp").distinct()
        gone = known.alias("k").join(wanted.alias("w"), same("k", "w"), "left_anti")
        added = wanted.alias("w").join(known.alias("k"), same("w", "k"), "left_anti")
    else:
        gone, added = None, wanted
    version, said = index.version + 1, _parts(index) if keep else []
    parts = list(said)
    part, minus = f"{version}", f"{version}-minus"
    # The listing is stored: what it takes to make it is done once, and its size is known to joins by it.
    listing = f"{path}/making/part={part}"
    _written(added.write, listing)
    added = spark.read.schema(added.schema).parquet(listing)
    held = held_rows(read(added.select(F.col("path").alias(path_col), F.col("stamp").alias(stamp_col))), key, path_col, stamp_col, text_col, metadata)
    schema = held.select("key", "path", "stamp", "meta").schema
    if keep and [f.dataType for f in schema] != [f.dataType for f in index.schema]:
        raise ValueError("the index holds other columns; build it anew under another path")
    some_gone = gone is not None and not gone.isEmpty()
    if some_gone:
        gone.select(F.col("part").alias("segment"), "path").write.mode("overwrite").parquet(f"{path}/deleted/part={minus}")
        parts.append((minus, True, *_write_minus(index, minus)))
    if not added.isEmpty():
        n, length = _write_segment(index, part, held, tokenizer)
        old = index.live(index.table("rows")) if keep else None
        if old is not None:
            if some_gone:
                gone_now = spark.read.parquet(f"{path}/deleted/part={minus}").select(F.col("segment"), F.col("path").alias("__p"))
                old = old.join(gone_now, (F.col("part") == F.col("segment")) & F.col("path").eqNullSafe(F.col("__p")), "left_anti")
            if not old.join(spark.read.parquet(f"{path}/rows/part={part}").select("key"), "key", "left_semi").isEmpty():
                raise ValueError("a key is in another file already")
        parts.append((part, False, n, length))
    _remove(spark, listing)
    if not some_gone and len(parts) == len(said):
        return index
    return _commit(spark, path, version, key, schema, parts)


def _write_minus(index: SegmentIndex, minus: str) -> tuple[int, int]:
    """Statistics of the rows that a list of deletions takes away; only their segments are read."""
    spark, path = index.spark, index.path
    gone = spark.read.parquet(f"{path}/deleted/part={minus}").select("segment", F.col("path").alias("__p"))
    touched = [r.segment for r in gone.select("segment").distinct().collect()]  # segments, not files
    hit = lambda df, at: df.filter(F.col("part").isin(touched)).join(gone, (F.col("part") == F.col("segment")) & F.col(at).eqNullSafe(F.col("__p")), "left_semi")
    # The dead rows of a block as one array, stored so that its size is known to the join: lists stay whole.
    making = f"{path}/making/part={minus}"
    dead = hit(index.table("rows").select("part", "path", "block", "row"), "path").groupBy("part", "block").agg(F.collect_list("row").alias("dead"))
    _written(dead.write, making)
    dead = spark.read.schema(dead.schema).parquet(making)
    lost = index.table("postings").filter(F.col("part").isin(touched)).select("part", "term", "block", "rows").join(dead, ["part", "block"])
    lost = lost.select("term", F.size(F.array_intersect("rows", "dead")).cast("long").alias("n")).filter("n > 0")
    _write_terms(lost.groupBy("term").agg(F.sum("n").alias("df")), f"{path}/terms/part={minus}")
    _remove(spark, making)
    total = hit(index.table("rows").select("part", "path", "length"), "path").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return total[0], total[1]


def compact(spark: SparkSession, path: str, tokenizer: Callable[[Column], Column] = regex_tokens) -> SegmentIndex:
    """All live rows as one segment, from the texts that the segments hold."""
    index = open_index(spark, path)
    if len(index.segments) + len(index.minus) < 2:
        return index
    held = index.live(index.table("texts")).select("key", "path", "stamp", "text", "meta")
    part = f"{index.version + 1}"
    n, length = _write_segment(index, part, held, tokenizer)
    return _commit(spark, path, index.version + 1, index.key, index.schema, [(part, False, n, length)])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete manifests but the last `keep`, then parts that none of those needs; what went."""
    known = _versions(spark, path)
    kept = [open_index(spark, path, v) for v in known[-keep:]]
    needed = {p for i in kept for p in [*i.segments, *i.minus]}
    went = []
    for v in known[:-keep]:
        _remove(spark, f"{path}/manifests/{v}")
    for name in ("postings", "terms", "grams", "rows", "texts", "deleted", "making"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(folder) if store.exists(folder) else []:
            at = status.getPath().getName()
            if at.removeprefix("part=") not in needed:
                store.delete(status.getPath(), True)
                went.append(f"{name}/{at}")
    return sorted(went)


def clear(spark: SparkSession, path: str) -> None:
    """Delete an index."""
    _remove(spark, path)


# ---- searching --------------------------------------------------------------------------


def _weights(times: Counter, df: dict[str, int], n: int) -> dict[str, float]:
    return {t: times[t] * math.log((n - d + 0.5) / (d + 0.5) + 1.0) for t, d in df.items() if d}


def _by_term(weights: dict[str, float]) -> Column:
    return reduce(lambda c, t: c.when(F.col("term") == t, F.lit(weights[t])), weights, F.when(F.lit(False), F.lit(0.0)))


def _asked(index: SegmentIndex, terms: list[str]) -> DataFrame:
    return index.table("postings").filter(F.col("bucket").isin(_buckets_of(terms)) & F.col("term").isin(terms))


def _entries(index: SegmentIndex, blocks: DataFrame, where: Column | None) -> DataFrame:
    """(term, key, f, length) of the live entries in `blocks`."""
    rows = index.live(index.table("rows"))
    if where is not None:
        # Metadata under their own names, and the index's apart from them.
        rows = rows.select(F.struct("part", "block", "row", "key", "length").alias("__own"), "meta.*").filter(where).select("__own.*")
    found = blocks.select("part", "block", "term", F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("fs").alias("f"))))
    # One struct: joined by columns, of which `part` is one of folders, rows would be pruned by a second scan.
    place = F.struct("part", "block", "row").alias("place")
    return found.select(place, "term", "f").join(rows.select(place, "key", "length"), "place").select("term", "key", "f", "length")


def _scores(entries: DataFrame, weights: dict[str, float], mean_length: float, k1: float, b: float) -> DataFrame:
    part = _by_term(weights) * saturated(F.col("f").cast("double"), F.col("length").cast("double"), F.lit(mean_length or 1.0), k1, b)
    return entries.withColumn("p", part).groupBy("key").agg(F.sum("p").alias("score"))


def wanted_blocks(index: SegmentIndex, weights: dict[str, float], k: int, k1: float = K1, b: float = B) -> tuple[DataFrame, float]:
    """(part, block, bound) of the blocks that can hold one of the best `k`, and the threshold.
    Reads bounds only, and the entries of the `k` blocks of the greatest bounds."""
    asked = _asked(index, list(weights))
    bound = _by_term(weights) * saturated(F.col("max_f").cast("double"), F.col("min_length").cast("double"), F.lit(index.mean_length), k1, b)
    bounds = asked.select("part", "block", bound.alias("bound")).groupBy("part", "block").agg(F.sum("bound").alias("bound"))
    first = bounds.orderBy(F.desc("bound")).limit(k).collect()
    by_part: dict[str, list[int]] = {}
    for r in first:
        by_part.setdefault(r.part, []).append(r.block)
    if not first:
        return bounds, 0.0
    chosen = reduce(lambda x, y: x | y, [(F.col("part") == p) & F.col("block").isin(bs) for p, bs in by_part.items()])
    best = top(_scores(_entries(index, asked.filter(chosen), None), weights, index.mean_length, k1, b), k, "key").collect()
    threshold = best[k - 1].score if len(best) == k else 0.0
    # Sums in another order may differ in their last digits.
    return bounds.filter(F.col("bound") >= threshold * (1 - 1e-9)), threshold


def search(index: SegmentIndex, query: Query, k: int | None = 10, where: Column | None = None, k1: float = K1, b: float = B, direct: int = DIRECT) -> DataFrame:
    """(key, score) of the best `k` (all: None), ties by key. `where` filters rows by their
    metadata before anything is counted, phrases filter what was found."""
    if k is not None and k < 0:
        raise ValueError("the number of hits can't be negative")
    times = Counter(query.terms)
    terms = sorted(times)
    if not index.version or not terms or k == 0:
        kind = index.schema["key"].dataType if index.version else T.LongType()
        return index.spark.createDataFrame([], T.StructType().add(index.key or "key", kind).add("score", "double"))
    if where is None:
        df, n, mean_length = index.document_frequency(terms), index.n, index.mean_length
        entries = _entries(index, _asked(index, terms), None)
    else:
        entries = _entries(index, _asked(index, terms), where)
        kept = index.live(index.table("rows")).select("length", "meta").select(F.col("length").alias("__length"), "meta.*").filter(where)
        n, mean_length = kept.agg(F.count("*"), F.avg("__length")).first()
        df = {r.term: r.df for r in entries.groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = _weights(times, df, n)
    if where is None and k and not query.phrases and sum(df.values()) > direct:
        wanted, _ = wanted_blocks(index, weights, k, k1, b)
        entries = _entries(index, _asked(index, terms).join(wanted.select("part", "block"), ["part", "block"], "left_semi"), None)
    out = _scores(entries, weights, mean_length, k1, b)
    if query.phrases:
        out = _with_phrases(index, out, query.phrases)
    out = out if k is None else top(out, k, "key")
    return out.select(F.col("key").alias(index.key), "score")


def phrase_candidates(index: SegmentIndex, phrase: str) -> DataFrame:
    """(part, block, key) of the live rows that hold all three-character runs of a phrase."""
    grams = sorted({phrase[i : i + GRAM] for i in range(max(1, len(phrase) - GRAM + 1))})
    table = index.table("grams")
    if len(phrase) < GRAM:
        # Beginnings of runs: folders are by whole runs, so all are looked through, by sorted runs.
        hit = table.filter(F.col("gram").startswith(phrase))
    else:
        hit = table.filter(F.col("bucket").isin(_buckets_of(grams)) & F.col("gram").isin(grams))
    # A block's lists go to one task as they are. A row stands once in the lists of a run.
    hit = hit.groupBy("part", "block").agg(F.flatten(F.collect_list("rows")).alias("rows")).select("part", "block", F.explode("rows").alias("row")).groupBy("part", "block", "row").agg(F.count("*").alias("n"))
    hit = hit if len(phrase) < GRAM else hit.filter(F.col("n") == len(grams))
    # A key may also stand, deleted, in an older segment.
    return hit.join(index.live(index.table("rows")).select("part", "block", "row", "key"), ["part", "block", "row"]).select("part", "block", "key")


def _with_phrases(index: SegmentIndex, scored: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """`scored` rows whose text holds all phrases; texts of no other rows than the candidates are read."""
    found = reduce(lambda x, y: x.join(y, ["part", "block", "key"], "left_semi"), [phrase_candidates(index, p) for p in phrases])
    hits = scored.join(found, "key")
    holds = reduce(lambda x, y: x & y, [F.col("text").contains(p) for p in phrases])
    texts = index.table("texts")
    some = hits.limit(BY_KEY + 1).collect()  # at most so many keys and scores
    if len(some) <= BY_KEY:
        spark, kind = index.spark, hits.schema
        buckets, keys, blocks = sorted({(r.block >> TASK_BITS) % BUCKETS for r in some}), sorted({r.key for r in some}), sorted({r.block for r in some})
        texts = texts.filter(F.col("bucket").isin(buckets) & F.col("block").isin(blocks) & F.col("key").isin(keys))
        hits = spark.createDataFrame([tuple(r) for r in some], kind)
    return hits.join(texts.select("part", "key", "text"), ["part", "key"]).filter(holds).select("key", "score")
