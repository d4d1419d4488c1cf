"""The search index against the scan, and typed date filters."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veloquy.functions.query import Query, parse_query
from veloquy.functions.text import regex_tokens
from veloquy.operators import postings, search
from veloquy.storage import new_path


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    texts = [None, "", "...", "Budget budget, talk"] + [" ".join(rnd.choices("budget talk road Straße ÉTÉ 12 12x a.b".split(), k=rnd.randrange(1, 90))) for _ in range(60)]
    return spark.createDataFrame([(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)], "key long, text string, lang string")


@pytest.fixture(scope="module")
def index(spark, rows):
    return postings.build(rows, new_path(spark, "index"), "key", metadata=("lang",), buckets=7)


@pytest.mark.parametrize("text", ["budget", "budget budget road", "straße été 12", "nowhere", "", '"talk"', 'road "budget talk" 12x', "a b"])
def test_index_finds_what_the_scan_finds(rows, index, text):
    query = parse_query(text)
    for tokens in (None, "tokens"):
        read = rows.withColumn("tokens", regex_tokens(F.col("text"))) if tokens else rows
        want = {r.key: round(r.score, 9) for r in search.bm25(read, query, tokens_col=tokens).collect()}
        assert {r.key: round(r.score, 9) for r in postings.search(index, query, None, texts=rows).collect()} == want
    some = rows.filter("lang = 'en'")
    want = {r.key: round(r.score, 9) for r in search.bm25(some, query).collect()}
    assert {r.key: round(r.score, 9) for r in postings.search(index, query, None, F.col("lang") == "en", rows).collect()} == want
    best = [r.key for r in postings.search(index, query, 3, texts=rows).collect()]
    assert best == [r.key for r in search.top(search.bm25(rows, query), 3, "key").collect()]


def test_index_reads_its_terms_folders_only(index):
    plan = postings.search(index, Query(("budget", "road")))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:40] and "PushedFilters: [In(__term" in plan.replace("IsNotNull(__term), ", "")


def test_columns_may_have_any_name_and_keys_are_unique(spark):
    rows = spark.createDataFrame([(1, "budget road", 5, "x", 2), (9, "budget", 6, "y", 3)], "bucket long, text string, length int, term string, f int")
    named = postings.build(rows, new_path(spark, "index"), "bucket", metadata=("length", "term", "f"))
    assert [r.bucket for r in postings.search(named, Query(("budget",))).collect()] == [9, 1]
    assert [r.bucket for r in postings.search(named, Query(("budget",)), where=(F.col("length") == 5) & (F.col("term") == "x") & (F.col("f") == 2)).collect()] == [1]
    for bad in ([(1, "a"), (1, "b")], [(1, "a"), (None, "b")]):
        with pytest.raises(ValueError):
            postings.build(spark.createDataFrame(bad, "key long, text string"), new_path(spark, "index"), "key")


def test_phrases_need_texts_and_an_empty_table_finds_nothing(spark, rows, index):
    with pytest.raises(ValueError):
        postings.search(index, parse_query('"budget talk"'))
    none = postings.build(rows.limit(0), new_path(spark, "index"), "key")
    assert postings.search(none, Query(("budget",))).count() == 0


def test_typed_dates_are_compared_as_dates(spark):
    days = [datetime.date(2026, 4, 5), datetime.date(2026, 5, 15), None]
    for kind, make in (("date", lambda d: d), ("timestamp", lambda d: d and datetime.datetime(d.year, d.month, d.day, 23, 59))):
        df = spark.createDataFrame([(make(d),) for d in days], f"date {kind}")
        assert search.filtered(df, since="2026年4月5日", until="2026-05-15").count() == 2
        assert search.filtered(df, since="2026-04-06").count() == 1 and search.filtered(df, until="2026-04-05").count() == 1


def test_terms_are_counted_within_a_row(spark):
    """So that postings are shuffled once, as they are written."""
    rnd = random.Random(5)
    rows = [(i, rnd.choices(["a", "b", "é", "語", "𝒳", ""], k=n)) for i, n in enumerate((1, 2, 3, 50, 2000))]
    found = spark.createDataFrame(rows, "i int, t array<string>").select("i", F.inline(postings.counted(F.col("t")))).collect()
    assert len(found) == len({(r.i, r.term) for r in found})
    assert {(r.i, r.term): r.f for r in found} == {(i, w): n for i, t in rows for w, n in Counter(t).items()}


def test_one_term_everywhere_is_dealt_to_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FILE_ROWS", 50)
    rows = spark.createDataFrame([(i, "same" if i % 7 else None) for i in range(400)], "k long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = postings.build(rows, str(tmp_path / "x"), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.postings.count() == 342 and len(index.postings.inputFiles()) > 1
    assert postings.search(index, Query(("same",), ()), None).count() == 342
