"""The incremental index against a scan of the rows that are live, version by version."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veloquy.functions.query import Query, parse_query
from veloquy.operators import search, segments
from veloquy.storage import new_path

QUERIES = ["budget", "budget budget road", "straße été 12", "nowhere", "", 'road "budget talk" 12x', 'talk "ge"', 'talk "T" "Budget"', "a b road talk budget"]
WORDS = "budget talk road Straße ÉTÉ 12 12x a.b Budget, Talk! 漢字".split()


def cues(rnd, path, stamp, n):
    rows = [(f"{path}#{i}", path, stamp, rnd.choice([None, "", " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 60)))]) if i % 5 == 0 else " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 90))), rnd.choice(["en", "de", None]), i) for i in range(n)]
    return rows


class Corpus:
    """Files as they are now; `read` gives their rows and notes which were asked for."""

    def __init__(self, spark, seed=3):
        self.spark, self.rnd, self.files, self.asked = spark, random.Random(seed), {}, []

    def put(self, path, stamp, n=12):
        self.files[path] = (stamp, cues(self.rnd, path, stamp, n))

    def listing(self):
        return self.spark.createDataFrame([(p, s) for p, (s, _) in self.files.items()], "path string, stamp long")

    def rows(self):
        return self.spark.createDataFrame([r for _, rows in self.files.values() for r in rows], "key string, path string, stamp long, text string, lang string, length int")

    def read(self, files):
        self.asked = sorted(r.path for r in files.collect())
        return self.rows().join(files, ["path", "stamp"], "left_semi")

    def update(self, path, **kw):
        return segments.update(self.spark, path, self.listing(), self.read, "key", metadata=("lang", "length"), **kw)


def same(index, rows, where=None, **kw):
    some = rows if where is None else rows.filter(where)
    same.turn += 3
    for text in [QUERIES[(same.turn + i) % len(QUERIES)] for i in range(3)]:
        query = parse_query(text)
        want = {r.key: round(r.score, 9) for r in search.bm25(some, query).collect()}
        if "direct" not in kw:
            assert {r.key: round(r.score, 9) for r in segments.search(index, query, None, where).collect()} == want, text
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [(r.key, round(r.score, 9)) for r in segments.search(index, query, 4, where, **kw).collect()] == best, text


same.turn = 0


def test_files_come_change_and_go(spark):
    corpus, path = Corpus(spark), new_path(spark, "segments")
    for i in range(4):
        corpus.put(f"f{i}", 1)
    first = corpus.update(path)
    assert first.version == 1 and corpus.asked == ["f0", "f1", "f2", "f3"]
    same(first, corpus.rows())
    before = corpus.rows().cache()
    before.count()
    corpus.put("f1", 2)
    corpus.put("f9", 1)
    del corpus.files["f3"]
    second = corpus.update(path)
    assert corpus.asked == ["f1", "f9"] and second.segments == ["1", "2"] and second.minus == ["2-minus"]
    same(second, corpus.rows())
    same(second, corpus.rows(), F.col("lang") == "en")
    same(second, corpus.rows(), (F.col("length") > 3) & F.col("lang").isNotNull())
    assert corpus.update(path).version == 2 and segments.open_index(spark, path).version == 2
    del corpus.files["f0"]
    corpus.put("f1", 3, 2)
    third = corpus.update(path)
    same(third, corpus.rows())
    same(third, corpus.rows(), direct=0)
    same(first, before)  # an old version still reads as it did
    whole = segments.compact(spark, path)
    assert whole.segments == ["4"] and whole.minus == [] and (whole.n, whole.length) == (third.n, third.length)
    same(whole, corpus.rows())
    went = segments.vacuum(spark, path)
    assert {w.split("/")[1] for w in went} == {"part=1", "part=2", "part=2-minus", "part=3", "part=3-minus"}
    same(segments.open_index(spark, path), corpus.rows())
    assert corpus.update(path, rebuild=True).segments == ["5"] and len(corpus.asked) == len(corpus.files)
    same(segments.open_index(spark, path), corpus.rows())
    corpus.files.clear()
    assert corpus.update(path).n == 0 and segments.search(segments.open_index(spark, path), parse_query("budget")).collect() == []
    segments.clear(spark, path)
    assert segments.open_index(spark, path).version == 0


def test_a_writer_that_stops_leaves_the_old_state(spark, monkeypatch):
    corpus, path = Corpus(spark, 5), new_path(spark, "segments")
    corpus.put("f0", 1)
    corpus.put("f1", 1)
    corpus.update(path)
    old = corpus.rows().cache()
    old.count()
    corpus.put("f1", 2)
    for step in ("_write_segment", "_write_terms", "_write_minus", "_commit"):
        with monkeypatch.context() as m:

            def stop(*a, **kw):
                raise RuntimeError(step)

            m.setattr(segments, step, stop)
            with pytest.raises(RuntimeError, match=step):
                corpus.update(path)
        index = segments.open_index(spark, path)
        assert index.version == 1
        for text in QUERIES[:3]:
            want = {r.key: round(r.score, 9) for r in search.bm25(old, parse_query(text)).collect()}
            assert {r.key: round(r.score, 9) for r in segments.search(index, parse_query(text), None).collect()} == want
    # A manifest without its mark of success is not there.
    spark.createDataFrame([("x",)], "part string").write.json(f"{path}/manifests/7")
    segments._remove(spark, f"{path}/manifests/7/_SUCCESS")
    assert corpus.update(path).version == 2
    same(segments.open_index(spark, path), corpus.rows())


def test_keys_that_repeat_are_refused(spark):
    corpus, path = Corpus(spark), new_path(spark, "segments")
    corpus.files["a"] = (1, [("k", "a", 1, "budget", "en", 1), ("k", "a", 1, "talk", "en", 2)])
    with pytest.raises(ValueError, match="repeat"):
        corpus.update(path)
    corpus.files["a"] = (1, [("k", "a", 1, "budget", "en", 1)])
    corpus.update(path)
    corpus.files["b"] = (1, [("k", "b", 1, "talk", "en", 2)])
    with pytest.raises(ValueError, match="another file"):
        corpus.update(path)
    assert segments.open_index(spark, path).version == 1


@pytest.fixture(scope="module")
def large(spark):
    """Documents whose lengths and counts differ: a frequent, a middling and a rare term."""
    rnd = random.Random(8)
    rows = []
    for i in range(6000):
        words = ["filler"] * rnd.choice([2, 5, 20, 60, 200]) + ["often"] * rnd.choice([0, 1, 1, 1, 2, 9]) + ["some"] * (rnd.random() < 0.05) + ["rare"] * (i in (77, 4321)) * 3
        rnd.shuffle(words)
        rows.append((i, f"p{i % 9}", 1, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, path string, stamp long, text string").cache()
    index = segments.update(spark, new_path(spark, "segments"), df.select("path", "stamp").distinct(), lambda f: df.join(f, ["path", "stamp"], "left_semi"), "id")
    return df, index


@pytest.mark.parametrize("terms", [("often",), ("often", "rare"), ("often", "some"), ("rare",), ("often", "some", "filler")])
def test_blocks_below_the_threshold_are_not_read(large, terms):
    df, index = large
    query = Query(terms)
    want = [(r.id, round(r.score, 9)) for r in search.top(search.bm25(df, query), 5, "id").collect()]
    for direct in (0, 10**9):
        assert [(r.id, round(r.score, 9)) for r in segments.search(index, query, 5, direct=direct).collect()] == want
    weights = segments._weights({t: 1 for t in terms}, index.document_frequency(list(terms)), index.n)
    wanted, threshold = segments.wanted_blocks(index, weights, 5)
    every = segments._asked(index, list(terms))
    read = every.join(wanted, ["part", "block"], "left_semi").agg(F.sum("n")).first()[0]
    assert abs(threshold - want[-1][1]) < 1e-6 or threshold < want[-1][1]
    total = every.agg(F.sum("n")).first()[0]
    assert read <= total and (terms == ("rare",) or read < total / 2)


def test_one_job_reads_folders_terms_and_needed_columns(large):
    _, index = large
    query = Query(("often", "some"))
    segments.search(index, query).collect()
    plan = segments.search(index, query)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(term" in plan and plan.count("Scan parquet") <= 2 and "text:string" not in plan
    physical = plan.split("== Physical Plan ==")[1]
    assert "meta" not in physical.split("ReadSchema")[1] and "PartitionFilters: [" in physical


def test_phrases_read_the_texts_of_candidates_only(large, spark):
    df, index = large
    for phrase in ("often rare", "rare filler", "e some f", "x", "ar"):
        query = Query(("filler", "often", "rare"), (phrase,))
        want = {r.id: round(r.score, 9) for r in search.bm25(df, query).collect()}
        assert {r.id: round(r.score, 9) for r in segments.search(index, query, None).collect()} == want
        found = {r.key for r in segments.phrase_candidates(index, phrase).collect()}
        grams = lambda t: {t[i : i + 3] for i in range(len(t))}
        inside = {r.id for r in df.collect() if all(any(g.startswith(x) for g in grams(r.text)) for x in ([phrase] if len(phrase) < 3 else {phrase[i : i + 3] for i in range(len(phrase) - 2)}))}
        assert found == inside
    few = segments._with_phrases(index, segments._scores(segments._entries(index, segments._asked(index, ["rare"]), None), {"rare": 1.0}, 10.0, 1.5, 0.75), ("rare",))
    plan = few._jdf.queryExecution().toString()
    assert "In(key" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "budget road", "p", 1, "x", 7, 2), (2, "budget", "p", 1, "y", 8, 3)], "bucket long, text string, path string, stamp long, term string, length int, `a b` int")
    index = segments.update(spark, new_path(spark, "segments"), df.select("path", "stamp").distinct(), lambda f: df.join(f, ["path", "stamp"], "left_semi"), "bucket", metadata=("term", "length", "a b"))
    assert [r.bucket for r in segments.search(index, Query(("budget",))).collect()] == [2, 1]
    assert [r.bucket for r in segments.search(index, Query(("budget",)), where=(F.col("term") == "x") & (F.col("length") == 7) & (F.col("a b") == 2)).collect()] == [1]


def test_runs_of_texts_of_any_length(spark):
    """One of each character, also beyond the first plane, in time in proportion to the text."""
    rng = random.Random(3)
    texts = ["", "a", "ab", "aaaa", "aé𝒳b𝒳b\n語", "".join(rng.choice("abcdefgé語𝒳 ") for _ in range(600_000))]
    began = time.monotonic()
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", segments.runs(F.col("text")).alias("runs")).collect()
    assert time.monotonic() - began < 60
    for r in found:
        assert sorted(r.runs) == sorted({r.text[i : i + segments.GRAM] for i in range(len(r.text))} or {""})


def test_texts_are_not_shuffled_and_lists_hold_places(spark, tmp_path):
    """What an update moves and writes: no text through a shuffle, lists of bytes in place of keys and metadata."""
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(400)]
    df = spark.createDataFrame([(i, f"p{i % 3}", 1, " ".join(rnd.choices(words, k=200)), "x" * 200) for i in range(1500)], "id long, path string, stamp long, text string, lang string").repartition(3)
    df.write.parquet(f"{tmp_path}/docs")
    df, path = spark.read.parquet(f"{tmp_path}/docs"), new_path(spark, "segments")
    moved = []
    monitor = spark._jsparkSession.sharedState().statusStore()
    seen = monitor.executionsCount()
    index = segments.update(spark, path, df.select("path", "stamp").distinct(), lambda f: df.join(f, ["path", "stamp"], "left_semi"), "id", metadata=("lang",))
    time.sleep(2)
    for i in range(seen, monitor.executionsCount()):
        run = monitor.executionsList().apply(i)
        values = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(monitor.executionMetrics(run.executionId()))
        names = {m.accumulatorId(): m.name() for m in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(run.metrics())}
        moved += [values[k] for k, name in names.items() if name == "shuffle bytes written" and k in values]
    total = sum(float(n.replace(",", "")) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}[unit] for n, unit in (m.split("\n")[-1].split(" (")[0].split()[:2] for m in moved))
    assert moved and total < 200_000  # 1.8 MB of texts
    kinds = {name: dict(index.table(name).dtypes) for name in ("postings", "grams")}
    assert kinds["postings"]["rows"] == kinds["grams"]["rows"] == "array<tinyint>" and "meta" not in str(kinds)
    want = {(r.term, r.id): r.f for r in df.select("id", F.explode(F.split("text", " ")).alias("term")).groupBy("term", "id").agg(F.count("*").alias("f")).collect()}
    found = segments._entries(index, index.table("postings"), None).collect()
    assert len(found) == len(want) and {(r.term, r.key): r.f for r in found} == want and {r.length for r in found} == {200}


def test_lists_of_blocks_in_batches_of_any_size():
    """Blocks that go on in the next batch, tokens and texts that are null or empty, characters 0 and beyond the first plane."""
    import pyarrow as pa

    from veloquy.functions import lists

    rnd = random.Random(4)
    rows = [(b, r, [rnd.choice(["a", "b", "ü", "", None]) for _ in range(rnd.randrange(5))] if rnd.random() < 0.9 else None, "".join(rnd.choices("ab\0𝒳\n語", k=rnd.randrange(1, 9)))) for b in (0, 128, 1 << 33) for r in range(40)]
    want_terms, want_grams = {}, {}
    for b, r, tokens, text in rows:
        for t in tokens or []:
            if t is not None:
                want_terms.setdefault((t, b), {}).setdefault(r, 0)
                want_terms[t, b][r] += 1
        for g in {text[i : i + 3] for i in range(len(text))}:
            want_grams.setdefault((g, b), set()).add(r)
    for size in (1, 7, 40, 500):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        kind = pa.schema([("block", pa.int64()), ("row", pa.int8()), ("length", pa.int32()), ("tokens", pa.list_(pa.string())), ("text", pa.string())])
        batches = [pa.RecordBatch.from_pylist([{"block": b, "row": r, "length": 100 - r, "tokens": t, "text": x} for b, r, t, x in c], kind) for c in cut]
        found = [p for batch in lists.postings(iter(batches)) for p in batch.to_pylist()]
        assert {(p["term"], p["block"]): dict(zip(p["rows"], p["fs"], strict=True)) for p in found} == want_terms and len(found) == len(want_terms)
        assert all(p["n"] == len(p["rows"]) and p["max_f"] == max(p["fs"]) and p["min_length"] == 100 - max(p["rows"]) for p in found)
        grams = [p for batch in lists.grams(iter(batches)) for p in batch.to_pylist()]
        assert {(p["gram"], p["block"]): set(p["rows"]) for p in grams} == want_grams and len(grams) == len(want_grams)
