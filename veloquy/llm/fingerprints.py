"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A text is a set of words weighted by their counts. For each word and each of SAMPLES draws,
hashes of the word give r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1); with weight w,
t = floor(ln w / r + b) and a = ln c - r (t + 1 - b). The draw's sample is the word and t of the
least a. Two texts share a sample with probability sum(min w) / sum(max w), the generalised
Jaccard similarity. As a is a function of word, draw and t, equal samples have equal a, so the
32-bit hash of the least a stands for the sample; a fingerprint is SAMPLES of them in hex.

Rows are dealt once, by ranges of ids, and stay there: next document, edited text, word counts
and samples are all computed within the same partitions.

Defined results: null text counts as empty; all texts without words share one fingerprint and
have likeness 1. Null ids count as below all others; among equal ids texts are ordered, and
identical rows give identical results up to their order. One row is its own next document. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

SAMPLES = 64
#: Draws computed in one row, so that the generated code stays small enough to be compiled.
DRAWS_A_ROW = 8
BUCKETS_A_TASK, TASKS_A_PARTITION = 8, 4
_LEAST = -(1 << 63)
_NONE = -1e300


def _unit(bits: Column) -> Column:
    """(0, 1) from the low 32 bits of a non-negative long."""
    return (bits + F.lit(0.5)) * F.lit(2.0**-32)


def _halves(h: Column) -> tuple[Column, Column]:
    return _unit(F.shiftrightunsigned(h, 32)), _unit(h.bitwiseAND(F.lit((1 << 32) - 1)))


def sample(term: Column, weights: list[Column], k: int) -> list[Column]:
    """ln a of draw k for the 64-bit term hash under each log weight; null weights give null."""
    u1, u2 = _halves(F.xxhash64(term, F.lit(3 * k)))
    u3, u4 = _halves(F.xxhash64(term, F.lit(3 * k + 1)))
    r, c = -F.ln(u1 * u2), -F.ln(u3 * u4)
    b = _unit(F.shiftrightunsigned(F.xxhash64(term, F.lit(3 * k + 2)), 32))
    return [F.ln(c) - r * (F.floor(w / r + b) + F.lit(1.0) - b) for w in weights]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[" + WORD[2:-2] + "]+"), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SAMPLES))


def hexed(samples: str) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def _ranged(docs: DataFrame) -> DataFrame:
    """`docs` (key, text) with `bucket`, dealt by it: rows of a bucket follow each other in
    descending key, and `ghost` marks a copy of the row that comes after a bucket's last one."""
    tasks = TASKS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = tasks * BUCKETS_A_TASK
    cuts = sorted(set(docs.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))))
    depth = max(1, math.ceil(math.log2(len(cuts) + 2)))
    steps = F.array(*[F.lit(int(x)) for x in cuts], *[F.lit((1 << 63) - 1)] * ((1 << depth) - 1 - len(cuts)))
    place = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(depth))]), F.lit(0), lambda at, step: F.when(F.element_at(steps, at + step) <= F.col("key"), at + step).otherwise(at))
    placed = docs.withColumn("bucket", place)
    heads = sorted((r.bucket, r.head) for r in placed.groupBy("bucket").agg(F.max("key").alias("head")).collect())
    # At most one row for each of the n buckets: its greatest key and the bucket it follows.
    after = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    follows = F.broadcast(docs.sparkSession.createDataFrame(after, "key long, follows int"))
    both = placed.join(follows, "key", "left").withColumn("copy", F.explode(F.when(F.col("follows").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("follows").alias("bucket"), F.lit(True).alias("ghost"))))))
    return both.select("key", "doc_id", "text", "copy.bucket", "copy.ghost").repartition(tasks, "bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    where the edited text has its last half replaced by the start of the next document."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), "text")
    n_chars = F.length("text").cast("long")
    half = F.floor(n_chars / 2).cast("int")
    row = _ranged(plain).select("bucket", "ghost", "doc_id", "text", F.lead("text").over(order).alias("following"), F.row_number().over(order).alias("place"), n_chars.alias("n_chars"), half.alias("half"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring(F.coalesce("following", F.lit("")), F.lit(1), F.col("half")))
    row = row.withColumn("edited", edited)
    own = words(F.col("text"))
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    # All that is computed once for a text stands below the explode.
    lists = row.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, F.size(own).alias("own"), F.concat(own, words(F.col("edited"))).alias("both"))
    each = lists.select(*keys, "own", F.posexplode_outer("both").alias("at", "word"))
    counted = each.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.sum((F.col("at") < F.col("own")).cast("long")).alias("w0"), F.sum((F.col("at") >= F.col("own")).cast("long")).alias("w1"))
    log = lambda w: F.when(F.col(w) > 0, F.ln(F.col(w).cast("double")))
    weighed = counted.select(*keys, "term", log("w0").alias("lw0"), log("w1").alias("lw1"))
    each_group = F.explode(F.array(*[F.lit(g) for g in range(SAMPLES // DRAWS_A_ROW)]))
    dealt = weighed.withColumn("group", each_group).withColumn("term", F.xxhash64("term", "group"))
    draws = [sample(F.col("term"), [F.col("lw0"), F.col("lw1")], k) for k in range(DRAWS_A_ROW)]
    least = dealt.groupBy(*keys, "group").agg(*[F.min(d[s]).alias(f"m{s}_{k}") for k, d in enumerate(draws) for s in (0, 1)])
    code = lambda s: F.array(*[F.shiftrightunsigned(F.xxhash64(F.coalesce(f"m{s}_{k}", F.lit(_NONE))), 32) for k in range(DRAWS_A_ROW)])
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group", code(0).alias("s0"), code(1).alias("s1")))).alias("all"))
    joined = lambda s: F.flatten(F.transform("all", lambda x: x.getField(s)))
    coded = whole.select(*keys, joined("s0").alias("s0"), joined("s1").alias("s1"))
    coded = coded.withColumn("s2", F.lead("s0").over(Window.partitionBy("bucket").orderBy("place"))).filter(~F.col("ghost"))
    return coded.select("doc_id", "n_chars", "edited_sha256", hexed("s0").alias("fingerprint"), hexed("s1").alias("edited_fingerprint"), likeness("s0", "s1").alias("near_edited"), likeness("s0", "s2").alias("near_next"))
