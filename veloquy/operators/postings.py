"""A search index made once: postings by term, and the lengths of rows. One that follows changing
files is in `segments`.

Two Parquet tables. `postings` has one row (term, key, f, length) for each term of each row,
in folders by a hash of the term and sorted by term within files, so that a query reads the
folders of its terms and in them the row groups that hold them. `rows` has the key, the length
and the metadata columns that searches filter by, without texts. A search reads both, never a
text, but for phrases. Scores are those of `search.bm25` over the same rows.

Building counts a row's terms within the row and shuffles one row for each of them once, by (bucket, a
hash of the key), so the postings of a frequent term are written by many tasks. The index's own columns begin with two
underscores, so key and metadata may have any other name; keys that are null or repeat are refused.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloquy.functions.query import Query
from veloquy.functions.text import once, regex_tokens
from veloquy.operators.search import B, K1, saturated, top

BUCKETS = 64
#: Tokens behind one file of a folder, on average, and postings of one term in it.
FILE_TOKENS = 1 << 20
FILE_ROWS = 1 << 21


def bucket_of(term: Column, buckets: int) -> Column:
    return (F.crc32(term) % buckets).cast("int")


@dataclass
class Index:
    postings: DataFrame
    rows: DataFrame
    key: str
    buckets: int
    df: dict[str, int] = field(default_factory=dict)  # of terms looked up without filters

    @property
    def whole(self) -> tuple[int, float]:
        """(rows, mean length) without filters, read once."""
        if not hasattr(self, "_whole"):
            r = self.rows.agg(F.count("*"), F.avg("__length")).first()
            self._whole = (r[0], r[1] or 0.0)
        return self._whole


def counted(tokens: Column) -> Column:
    """array<struct<term, f>> of an array that is not empty: each token with its number."""

    def of(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
        ends = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(a))
        return once(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(a, i).alias("term"), (ends(s, j) - i).alias("f"))))

    return once(F.sort_array(tokens), of)


def build(rows: DataFrame, path: str, key: str, text_col: str = "text", tokens_col: str | None = None, metadata: tuple[str, ...] = (), buckets: int = BUCKETS) -> Index:
    """Write the index of `rows` under `path`; keys must be unique."""
    tokens = regex_tokens(F.col(text_col)) if tokens_col is None else F.col(tokens_col)
    split = rows.select(F.col(key), *metadata, tokens.alias("__tokens"))
    split.select(key, *metadata, F.size("__tokens").alias("__length")).write.mode("overwrite").parquet(f"{path}/rows")
    spark = rows.sparkSession
    n, known, distinct, tokens = spark.read.parquet(f"{path}/rows").agg(F.count("*"), F.count(key), F.countDistinct(key), F.coalesce(F.sum("__length"), F.lit(0))).first()
    if not n == known == distinct:
        raise ValueError("keys are null or repeat")
    each = split.select(key, F.size("__tokens").alias("__length"), "__tokens").filter("__length > 0").select(key, "__length", F.inline(counted(F.col("__tokens"))))
    dealt = each.select(F.col("term").alias("__term"), key, "__length", F.col("f").alias("__f"), bucket_of(F.col("term"), buckets).alias("__bucket"))
    # Dealing by hashes makes the rows once; ranges would make them twice, the first time for their bounds.
    splits = max(1, -(-tokens // (buckets * FILE_TOKENS)), -(-n // FILE_ROWS))
    dealt = dealt.repartition(F.col("__bucket"), F.pmod(F.xxhash64(key), F.lit(splits))).sortWithinPartitions("__bucket", "__term")
    dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/postings")
    return open_index(spark, path, key, buckets)


def open_index(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> Index:
    rows = spark.read.parquet(f"{path}/rows")
    # An index of no terms has no folders to tell the columns by.
    kind = T.StructType().add("__term", "string").add(key, rows.schema[key].dataType).add("__length", "integer").add("__f", "integer").add("__bucket", "integer")
    return Index(spark.read.schema(kind).parquet(f"{path}/postings"), rows, key, buckets)


def search(index: Index, query: Query, k: int | None = 10, where: Column | None = None, texts: DataFrame | None = None, text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the best `k` (all: None), ties by key. `where` filters rows by their
    metadata before anything is counted; phrases need `texts` with key and text."""
    times = Counter(query.terms)
    terms = sorted(times)
    key = index.key
    if query.phrases and texts is None:
        raise ValueError("phrases are looked up in texts")
    places = sorted({zlib.crc32(t.encode()) % index.buckets for t in terms})
    found = index.postings.filter(F.col("__bucket").isin(places) & F.col("__term").isin(terms)).select("__term", key, "__f", "__length")
    n, mean_length = index.whole
    if where is not None:
        kept = index.rows.filter(where)
        found = found.join(kept.select(key), key, "left_semi")
        n, mean_length = kept.agg(F.count("*"), F.avg("__length")).first()
    # One number for each term of the query.
    count = lambda rows: {r[0]: r[1] for r in rows.groupBy("__term").agg(F.count("*")).collect()}
    if where is None:
        new = [t for t in terms if t not in index.df]
        if new:
            index.df |= dict.fromkeys(new, 0) | count(found.filter(F.col("__term").isin(new)))
        df = {t: index.df[t] for t in terms}
    else:
        df = count(found)
    weights = {t: times[t] * math.log((n - d + 0.5) / (d + 0.5) + 1.0) for t, d in df.items()}
    use = reduce(lambda c, t: c.when(F.col("__term") == t, F.lit(weights[t])), weights, F.when(F.lit(False), F.lit(0.0)))
    part = use * saturated(F.col("__f").cast("double"), F.col("__length").cast("double"), F.lit(mean_length or 1.0), k1, b)
    out = found.groupBy(key).agg(F.sum(part).alias("score"))
    if query.phrases:
        hits = texts.select(key, text_col).join(out, key)
        out = reduce(lambda d, p: d.filter(F.col(text_col).contains(p)), query.phrases, hits).select(key, "score")
    return out if k is None else top(out, k, key)
