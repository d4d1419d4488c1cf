"""Ranked full-text search (BM25) over a table of cues or documents.

Statistics (number of rows, mean length, document frequency) come from the rows that pass the
metadata filters, before phrases are looked at. Terms are alternatives; a term given twice
counts twice; without terms nothing is found. Only query terms are counted, inside the row that
holds them, so no token is ever shuffled: one aggregate gives all statistics, and the scores are
a projection and a top-k. Without a column of tokens the text itself is read: lengths are counts
of runs, and only rows whose lower-cased text contains a term at all are looked at for it.

A table that is searched often is better indexed once, see `postings`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquy.functions.query import Query
from veloquy.functions.text import TOKEN, lowered, normal_date

K1, B = 1.5, 0.75


def filtered(rows: DataFrame, since: str | None = None, until: str | None = None, speaker: str | None = None, committee: str | None = None, house: str | None = None) -> DataFrame:
    """Metadata filters. Dates are compared as normalised strings, so an empty date passes
    `until` and fails `since`; names and titles are matched as literal substrings. A column
    `date` of type date or timestamp is compared as it is, so that the bounds reach the files."""
    kind = dict(rows.dtypes).get("date")
    typed = kind in ("date", "timestamp", "timestamp_ntz")
    day = lambda text: F.to_date(normal_date(F.lit(text)))
    if since:
        rows = rows.filter(F.col("date") >= day(since) if typed else normal_date(F.col("date")) >= normal_date(F.lit(since)))
    if until:
        rows = rows.filter((F.col("date") < F.date_add(day(until), 1)) if typed else normal_date(F.col("date")) <= normal_date(F.lit(until)))
    if speaker:
        rows = rows.filter(F.coalesce("speaker_name", F.lit("")).contains(speaker))
    if committee:
        rows = rows.filter(F.coalesce("title", F.lit("")).contains(committee))
    if house:
        rows = rows.filter(F.col("house") == house)
    return rows


def _of_tokens(tokens: Column) -> tuple[Column, Callable[[str], Column], Callable[[str], Column]]:
    """(length, whether a term occurs, how often) of an array of tokens."""
    return F.size(tokens), lambda t: F.array_contains(tokens, t), lambda t: F.size(F.filter(tokens, lambda x: x == t))


def _of_text(text: Column) -> tuple[Column, Callable[[str], Column], Callable[[str], Column]]:
    """As `_of_tokens`, for the tokens of a text."""
    low = lowered(text)
    alone = lambda t: rf"(?<![\p{{L}}\p{{N}}])\Q{t}\E(?![\p{{L}}\p{{N}}])"
    return F.regexp_count(low, F.lit(TOKEN)), lambda t: low.contains(t) & low.rlike(alone(t)), lambda t: F.when(low.contains(t), F.regexp_count(low, F.lit(alone(t)))).otherwise(0)


def statistics(rows: DataFrame, terms: list[str], text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row: n, mean_length and df_i for each term, by one aggregate with partial sums."""
    length, has, _ = _of_text(F.col(text_col)) if tokens_col is None else _of_tokens(F.col(tokens_col))
    counts = [F.sum(has(t).cast("long")).alias(f"df_{i}") for i, t in enumerate(terms)]
    return rows.agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"), *counts)


def weight(n: Column, df: Column) -> Column:
    """What a term counts by its document frequency."""
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def saturated(f: Column, length: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    return (f * (k1 + 1)) / (f + k1 * (1 - b + b * length / mean_length))


def bm25(rows: DataFrame, query: Query, text_col: str = "text", tokens_col: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """`rows` that match with a `score` column, unordered."""
    times = Counter(query.terms)
    terms = sorted(times)
    if not terms:
        return rows.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    length, has, often = _of_text(F.col(text_col)) if tokens_col is None else _of_tokens(F.col(tokens_col))
    stats = F.broadcast(statistics(rows, terms, text_col, tokens_col))  # always one row
    matched = rows.filter(reduce(lambda x, y: x | y, [has(t) for t in terms]))
    for phrase in query.phrases:
        matched = matched.filter(F.col(text_col).contains(phrase))
    matched = matched.withColumns({"__length": length.cast("double"), **{f"__f{i}": often(t).cast("double") for i, t in enumerate(terms)}})
    each = [times[t] * weight(F.col("n").cast("double"), F.col(f"df_{i}").cast("double")) * saturated(F.col(f"__f{i}"), F.col("__length"), F.col("mean_length"), k1, b) for i, t in enumerate(terms)]
    out = matched.crossJoin(stats).withColumn("score", reduce(lambda x, y: x + y, each))
    return out.select(*rows.columns, "score")


def top(hits: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best by score, ties in order of the columns `tie`."""
    if k < 0:
        raise ValueError("the number of hits can't be negative")
    return hits.orderBy(F.desc("score"), *tie).limit(k)


def search(rows: DataFrame, query: Query, k: int = 10, tie: tuple[str, ...] = ("src_ord", "cue_idx"), text_col: str = "text", **filters) -> DataFrame:
    return top(bm25(filtered(rows, **filters), query, text_col), k, *tie)
