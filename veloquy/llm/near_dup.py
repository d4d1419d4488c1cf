"""MinHash near-duplicate groups over word shingles, with every link confirmed on full sets.

A text's set holds its distinct five-word shingles as 52-bit hashes (fewer words: the whole
sequence as one; none: empty). 384 minima of strongly universal hashes (a * x + b modulo 2**64,
upper half) make 64 bands of 6; two sets of similarity 0.75 miss all bands with probability
4e-6. Texts with equal sets form one class, a node with a number of its own; signatures are
pre-aggregated to one row a class before they are shuffled, and only classes go on:

1. Stars: in every bucket each member is compared with the one that shares most buckets with
   others (the original among its copies, as a rule).
2. Components of the confirmed links by alternating large-star and small-star.
3. Rest: members of one bucket that are still in different components. Those whose shingles
   occur too rarely in texts of other components to reach the similarity with anything in the
   bucket are done (an exact bound); the others are compared in pairs, each pair in the first
   bucket that it shares. Nothing is capped or dropped.
4. Components over all links, then the least id of each.

Pairs are first held against their signatures (four bits of each minimum; a pair of similarity
0.75 has 258 agreeing minima with probability 1 - 1e-5), then the sets of the pairs left are fetched. Large joins are between stored or shuffled tables
with one unique side, so that Spark can split a hot bucket, centre or class.

Defined results: null or empty texts and texts without words have an empty set and are linked
with nothing. A row with a null id takes part in nothing: its component is null and it is kept.
Repeated rows give repeated result rows. Rows of one id with different texts are classes of their
own and each gets its own text's component. An empty table gives an empty result. Columns other
than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import discard, small_batches, stored
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 64, 6
#: Bits kept of each minimum, and how many minima must agree in all of them.
PLANES, LEAST_AGREEING = 4, 258
#: Bits of the filter that rows pass before their texts are shuffled; it is broadcast, 64 bits a row.
FILTER_BITS = 1 << 25
#: What tells the set of a text from others.
CLASS = ("n_shingles", "digest1", "digest2")
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_DIGEST_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, as (values, bounds); at most 4096 texts."""
    w = tn.words(texts, lower=True)
    n, hashes = len(w.ptr) - 1, w.hashes()
    at, key = tn.windows(hashes, w.doc, width)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    total = tn.prefix(hashes)
    doc = np.concatenate([w.doc[at], short])
    key = np.concatenate([key, tn.spans(total, w.ptr[short], w.ptr[short + 1])]) if len(short) else key
    both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (key >> np.uint64(12)))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    bounds = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(52))
    return both & np.uint64((1 << 52) - 1), bounds


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of all hashes for each non-empty set, one row for each set, as 32-bit values."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    start = bounds[full]
    x = tn.mix64(values) >> np.uint64(32)
    out = np.empty((len(full), BANDS * ROWS), np.uint32)
    work = np.empty_like(x)
    for k in range(BANDS * ROWS if len(full) else 0):
        np.multiply(x, _A[k], out=work)
        np.add(work, _B[k], out=work)
        out[:, k] = np.minimum.reduceat(work, start) >> np.uint64(32)
    return out


def _digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums of hashes that tell a set from others; 0 for an empty one."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[0, full] = np.add.reduceat(tn.mix64(values), bounds[full])
        out[1, full] = np.add.reduceat(tn.mix64(values ^ _DIGEST_SALT), bounds[full])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest1, digest2, bands, planes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                values, bounds = shingle_sets(part.column("text"))
                size = np.diff(bounds)
                full = np.flatnonzero(size > 0)
                least = minima(values, bounds)
                digest = _digests(values, bounds)
                keys = np.zeros((len(full), BANDS), np.uint64)
                if len(full):
                    for b in range(BANDS):
                        key = np.full(len(full), b + 1, np.uint64)
                        for r in range(ROWS):
                            key = tn.mix64(key ^ least[:, b * ROWS + r].astype(np.uint64))
                        keys[:, b] = key
                held = np.zeros(len(size) + 1, np.int32)
                held[1:] = np.cumsum(size > 0) * BANDS
                bands = pa.ListArray.from_arrays(pa.array(held), pa.array(keys.reshape(-1).view(np.int64)))
                bits = [np.packbits((least >> np.uint32(p)) & np.uint32(1) == 1, axis=1, bitorder="little").view(np.int64) for p in range(PLANES)]
                packed = np.concatenate(bits, axis=1) if len(full) else np.zeros((0, PLANES), np.int64)
                planes = pa.ListArray.from_arrays(pa.array(held // BANDS * packed.shape[1]), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), bands, planes],
                    names=["doc_id", "n_shingles", "digest1", "digest2", "bands", "planes"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest1 long, digest2 long, bands array<long>, planes array<long>")


def _agree(a: str, b: str) -> Column:
    """At least LEAST_AGREEING of the minima of two `planes` columns agree in PLANES bits."""
    words = BANDS * ROWS // 64
    differ = [reduce(lambda x, y: x.bitwiseOR(y), [F.col(a)[p * words + i].bitwiseXOR(F.col(b)[p * words + i]) for p in range(PLANES)]) for i in range(words)]
    return reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ]) <= BANDS * ROWS - LEAST_AGREEING


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest1, digest2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                values, bounds = shingle_sets(part.column("text"))
                one, two = _digests(values, bounds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", *CLASS])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest1 long, digest2 long")


def _possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id may be in `ids`: all that are, and some others. The filter has
    FILTER_BITS bits whatever the tables' size; where ids are so many that most bits are set, it
    lets most rows through and the join behind it is what it would be without."""
    place = F.pmod(F.xxhash64(F.lit("filter"), F.col("doc_id")), F.lit(FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    words = stored(words, "filter")  # FILTER_BITS / 64 rows at most
    placed = docs.withColumn("p", place)
    found = placed.join(F.broadcast(words), F.floor(F.col("p") / 64) == F.col("word"))
    return found.filter(F.getbit("bits", (F.col("p") % 64).cast("int")) == 1).select(docs.columns)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the classes in `wanted` (node, doc_id, digest1, digest2), from the text of
    one row of each. Rows pass a filter of fixed size before their texts are joined, and so shuffled
    where Spark doesn't find `wanted` small enough to broadcast: those wanted and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.chunks(batch, "text"):
                values, bounds = shingle_sets(part.column("text"))
                own = _digests(values, bounds).view(np.int64)
                same = (own[0] == part.column("digest1").to_numpy()) & (own[1] == part.column("digest2").to_numpy())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "items"]).filter(pa.array(same))

    texts = _possible(docs, wanted).join(wanted, "doc_id").select("node", "digest1", "digest2", "text")
    return texts.mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def _side(table: DataFrame, x: str) -> DataFrame:
    return table.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in table.columns])


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a similarity of `percent` / 100."""
    narrow = nodes.select("node", "n_shingles", "planes")
    fits = (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")) & _agree("planes_a", "planes_b")
    return pairs.join(_side(narrow, "b"), "b").join(_side(narrow, "a"), "a").filter(fits).select("a", "b")


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with similarity of at least `percent` / 100 by full sets. `b` is the side that
    few pairs share, so its set is fetched first."""
    shared = F.size(F.array_intersect("items_a", "items_b"))
    enough = 100 * shared >= percent * (F.size("items_a") + F.size("items_b") - shared)
    return likely.join(_side(sets, "b"), "b").join(_side(sets, "a"), "a").filter(enough).select("a", "b")


def _linkable(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Entries of `placed` that can have a link to another component in their bucket, with
    `common`: how many of the set's shingles occur in a set of another component. Two such sets
    share at most the smaller `common`, so a link needs (100 + percent) * common >= percent *
    (both sizes), and an entry whose common shingles don't suffice even with the least set of
    its bucket has none."""
    items = sets.join(placed.select("node", "component").distinct(), "node").select("node", "component", F.explode("items").alias("item"))
    within = stored(items.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low = high").select("item"), "within")
    own = items.join(within, "item", "left_semi").groupBy("node").agg(F.count("*").alias("own"))
    known = stored(placed.join(own, "node", "left").withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0))).drop("own"), "known")
    least = stored(known.groupBy("key").agg(F.min("n_shingles").alias("least")), "least")
    found = known.join(least, "key").filter((100 + percent) * F.col("common") >= percent * (F.col("n_shingles") + F.col("least"))).drop("least")
    found = stored(found, "linkable")
    discard(within, known, least)
    return found


def _mixed(entries: DataFrame) -> DataFrame:
    """Entries of buckets with more than one component."""
    keys = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    keys = stored(keys.select("key"), "keys")
    found = stored(entries.join(keys, "key", "left_semi"), "mixed")
    discard(keys)
    return found


def _pairs(entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one bucket in different components whose common shingles suffice and
    whose signatures agree, each in the first bucket that has both."""
    known = entries.join(nodes.select("node", "bands", "planes"), "node")
    side = lambda x: known.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n_shingles", "common", "bands", "planes")])
    enough = (100 + percent) * F.least("common_a", "common_b") >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    crossing = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
    first = F.array_intersect("bands_a", "bands_b")[0] == F.col("key")
    found = side("a").join(side("b"), "key").filter(crossing & enough & _agree("planes_a", "planes_b") & first)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`."""
    plain = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = signatures(plain).filter("doc_id is not null and n_shingles > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    spread = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    buckets = stored(spread.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    shared = stored(spread.join(buckets, "key"), "shared")
    discard(buckets)
    degree = stored(shared.groupBy("node").agg(F.sum("members").alias("degree")), "degree")
    wanted = stored(nodes.select("node", "doc_id", "digest1", "digest2").join(degree, "node", "left_semi"), "wanted")
    sets = stored(_sets(plain, wanted), "sets")
    centre = stored(shared.join(degree, "node").groupBy("key").agg(F.max_by("node", "degree").alias("a")), "centres")
    star = shared.select("key", F.col("node").alias("b")).join(centre, "key").filter("a <> b").select("a", "b").distinct()
    likely = stored(_likely(star, nodes, percent), "likely")
    links = stored(_confirmed(likely, sets, percent), "links")
    first = connected_components(links, "a", "b")

    placed = shared.join(first, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    mixed = _mixed(placed)
    linkable = _linkable(mixed, sets, percent)
    rest = _mixed(linkable)
    pairs = stored(_pairs(rest, nodes, percent), "pairs")
    more = _confirmed(pairs, sets, percent)
    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))
    final = connected_components(joined, "a", "b")
    discard(shared, degree, wanted, centre, likely, links, sets, mixed, linkable, rest, pairs)

    found = stored(nodes.select("node", "doc_id", *CLASS).join(final, "node"), "found")
    least = stored(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    single = nodes.select("node", *CLASS, F.col("doc_id").alias("component_id")).join(final.select("node"), "node", "left_anti").drop("node")
    of_class = found.join(least, "component").select(*CLASS, "component_id").unionByName(single)
    # Empty sets are linked with nothing: spread over all tasks, they meet no class.
    member = _sized(plain).withColumn("digest1", F.when(F.col("n_shingles") == 0, F.xxhash64("doc_id")).otherwise(F.col("digest1")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return member.join(of_class, [*CLASS], "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
