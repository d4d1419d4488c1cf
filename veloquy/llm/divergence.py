"""How far apart the sources of a language are in their use of terms, and by which terms.

Terms are counted in tasks, by language, source and term, before anything moves; Spark adds the
counts up and keeps the terms that stand in enough documents of their language. Kept terms are dealt to
blocks by a hash. A block's task lays its counts out as a dense int64 matrix of sources by terms,
turns it into smoothed shares p, and compares all pairs of sources by broadcasting, a tile of
sources against another over a few terms at a time. It returns the sum of |p - q| for each pair
over its terms (partial pair matrices, which Spark adds up) and for each source the best of its
own terms (a heap of bounded size; Spark keeps the best of the heaps of a task before the shuffle,
and of all after it). A block has fewer terms the more sources there are, so its matrix is bounded.

p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)) is computed digit group by digit group, as the
product would not fit 64 bits on large corpora.

The pairs of a language's sources are the report itself, each with all the others; no row of the
input is paired with another. Counts are kept as one row a term with its sources.

Defined results: null text, language and source are ''. Groups without terms take part with counts
of 0; a language without kept terms has pairs of value 0; a source alone in its language has no
rows. Texts of any length are counted whole; repeated rows count as often as they stand there;
ties are ordered by the item's UTF-8 bytes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import discard, small_batches, stored

LEAST_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
#: Cells of a block's matrix, and terms of a block at most and at least.
CELLS, MOST_TERMS, FEWEST_TERMS = 1 << 21, 4096, 64
#: Sources of a tile, and cells of what two tiles are broadcast to.
TILE, BROADCAST_CELLS = 64, 1 << 21
#: Rows of counts that a task holds before it sends them on.
HELD = 400_000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of its text, term) of each run of letters and bytes beyond ASCII, A-Z lower-cased."""
    data, offsets = tn.raw(texts)
    inside = _IN_TERM[data]
    start, end, ptr = tn.runs(inside, offsets)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    body = tn.LOWER[data[inside]]
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(body.tobytes())])
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), terms


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of the rows of a task, added up as far as HELD allows."""
    keys = ["lang", "source", "term"]
    names = [*keys, "count", "docs"]
    held: list[pa.Table] = []

    def added() -> pa.Table:
        found = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
        return found.select([*keys, "count_sum", "docs_sum"]).rename_columns(names)

    for batch in batches:
        for part in tn.chunks(batch, "text"):
            doc, terms = _terms(part.column("text"))
            coded = terms.dictionary_encode()
            code, width = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
            pair, count = np.unique(doc * width + code, return_counts=True)
            of = pa.array(pair // width)
            held.append(pa.table({
                "lang": part.column("lang").take(of), "source": part.column("source").take(of), "term": coded.dictionary.take(pa.array(pair % width)).cast(pa.string()),
                "count": count, "docs": np.ones(len(pair), np.int64),
            }))
        if sum(t.num_rows for t in held) > HELD:
            held[:] = [added()]
            if held[0].num_rows > HELD // 2:
                yield from held[0].to_batches()
                held.clear()
    if held:
        yield from added().to_batches()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, sources array<struct<source, count>>) of the terms that stand in at least
    `least_docs` documents of their language; `docs` has lang, source and text without nulls."""
    found = small_batches(docs.select("lang", "source", "text")).mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    found = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("sources"))
    return found.filter(F.col("docs") >= least_docs).select("lang", "term", "sources")


def shares(count: np.ndarray, total: np.ndarray, smoothing: int = SMOOTHING) -> np.ndarray:
    """1 + floor(10**9 * (count + smoothing) / total), exact while total is below 2**53."""
    whole, rest = np.divmod(count + smoothing, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial pair sums (part 'pair') and best terms (part 'term') of one block: `left` has its
    terms, `right` all sources of the language with their totals."""
    lang = key[0].as_py()
    order = pc.sort_indices(right, [("source", "ascending")])
    sources = right["source"].take(order).to_pylist()
    total, overall = right["total"].take(order).to_numpy(), right["overall"][0].as_py()
    terms = left["term"].combine_chunks() if left.num_rows else pa.array([], pa.string())
    matrix = np.zeros((len(sources), len(terms)), np.int64)
    if len(terms):
        lists = left["sources"].combine_chunks()
        each = lists.flatten()
        row = pc.index_in(each.field("source"), value_set=pa.array(sources, pa.string())).to_numpy()
        matrix[row, np.repeat(np.arange(len(terms)), lists.value_lengths().to_numpy())] = each.field("count").to_numpy()
    p = shares(matrix, total[:, None])
    apart = np.zeros((len(sources), len(sources)), np.int64)
    for i in range(0, len(sources), TILE):
        for j in range(i, len(sources), TILE):
            a, b = p[i : i + TILE], p[j : j + TILE]
            step = max(1, BROADCAST_CELLS // (len(a) * len(b)))
            for t in range(0, len(terms), step):
                apart[i : i + TILE, j : j + TILE] += np.abs(a[:, None, t : t + step] - b[None, :, t : t + step]).sum(2)
    first, second = np.triu_indices(len(sources), 1)
    q = shares(matrix.sum(0), np.array([overall])) if len(terms) else np.zeros(0, np.int64)
    names = terms.to_pylist()
    best: list[tuple[int, str, int]] = []
    for s in range(len(sources)):
        above = np.flatnonzero((matrix[s] > 0) & (p[s] > q))
        value = p[s, above] - q[above]
        if len(above) > TOP_TERMS:  # those that tie with the last place stay for the comparison of names
            keep = value >= np.partition(value, -TOP_TERMS)[-TOP_TERMS]
            above, value = above[keep], value[keep]
        best += heapq.nsmallest(TOP_TERMS, ((s, -int(v), names[t].encode()) for v, t in zip(value, above, strict=True)))
    return pa.table({
        "lang": pa.array([lang] * (len(first) + len(best)), pa.string()),
        "source": pa.array([sources[i] for i in first] + [sources[b[0]] for b in best], pa.string()),
        "part": pa.array(["pair"] * len(first) + ["term"] * len(best), pa.string()),
        "item": pa.array([sources[i] for i in second] + [b[2].decode() for b in best], pa.string()),
        "value": pa.array(np.concatenate([apart[first, second], np.array([-b[1] for b in best], np.int64)])),
    })


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance from
    every other (part 'pair') and the terms by which it stands out (part 'term')."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    plain = docs.select(*blank)
    kept = stored(term_counts(plain, least_docs), "terms")
    groups = stored(plain.select("lang", "source").distinct(), "groups")
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    counts = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sums = groups.join(counts, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    # One row a source, and one a language: both grow with the number of sources only.
    sums = stored(sums, "sums")
    langs = sums.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("groups")).join(n_terms, "lang", "left").fillna(0, ["terms"])
    in_block = F.greatest(F.lit(FEWEST_TERMS), F.least(F.lit(MOST_TERMS), F.floor(F.lit(CELLS) / F.col("groups"))))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / in_block)))
    langs = stored(langs.select("lang", "blocks", (F.col("all") + SMOOTHING * F.col("terms")).alias("overall"), F.col("terms")), "langs")
    dealt = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "sources")
    each = sums.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.greatest(F.lit(1), F.col("n") + SMOOTHING * F.col("terms")).alias("total"), F.greatest(F.lit(1), "overall").alias("overall"))
    found = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, part string, item string, value long")
    found = stored(found, "blocks")
    discard(kept, groups)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p")
    pairs = pairs.select("lang", both, "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(place))
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
