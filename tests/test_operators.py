"""Semantics that the driver's tables don't reach, on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from columns import SPEAKERS, many, one
from veloquy.functions import text as tx
from veloquy.functions.query import Query, parse_query
from veloquy.operators import attribution as at
from veloquy.operators import catalog, render, search
from veloquy.sources import captions
from veloquy.streaming import tokens

CUE = "array<struct<start: double, end: double, text: string>>"


@pytest.fixture(scope="module")
def cues(spark):
    rows = [
        ("shugiin", "9", "2026年5月15日", "A委員会", "http://p?x=1", 0, 1.5, "budget talk budget", None, "m1"),
        ("shugiin", "9", "2026年5月15日", "A委員会", "http://p?x=1", 1, 9.0, "talk of roads", "Ann", "m1"),
        ("sangiin", "8", "2026-04-05", "B会", "http://q", 0, 3.0, "budget", "Bob", "m2"),
        ("sangiin", "7", "", "C会", "", 0, 4.0, "budget", "Bob", "m3"),
    ]
    return spark.createDataFrame(rows, "house string, id string, date string, title string, page_url string, cue_idx int, start double, text string, speaker_name string, meta_path string").withColumn("src_ord", F.col("meta_path")).withColumn("speaker_group", F.lit(None).cast("string"))


def test_filters(cues):
    ids = lambda **kw: sorted((r.id, r.cue_idx) for r in search.filtered(cues, **kw).collect())
    assert ids(since="2026-05-01") == [("9", 0), ("9", 1)]
    assert ids(until="2026-05-01") == [("7", 0), ("8", 0)]  # an empty date is before all others
    assert ids(speaker="nn") == [("9", 1)] and ids(committee="会") == ids() and ids(house="sangiin", since="2000-01-01") == [("8", 0)]


def test_search_semantics(cues):
    got = search.search(cues, Query(("budget",)), 10).collect()
    assert [r.meta_path for r in got] == ["m2", "m3", "m1"] and got[0].score == got[1].score  # ties keep their order
    double = search.search(cues, Query(("budget", "budget")), 10).collect()
    assert [r.score for r in double] == pytest.approx([2 * r.score for r in got])
    assert search.search(cues, Query((), ("budget",))).count() == 0
    phrase = search.search(cues, Query(("budget",), ("budget talk",))).collect()
    assert [(r.meta_path, r.score) for r in phrase] == [("m1", got[2].score)]  # counted before the phrase
    assert search.search(cues, Query(("budget",)), house="shugiin").first().score != got[2].score
    assert search.search(cues, Query(("nothing",))).count() == 0 and search.search(cues, Query(("roads", "budget"))).count() == 4
    with pytest.raises(ValueError):
        search.top(cues.withColumn("score", F.lit(1.0)), -1)


def test_query_text():
    assert parse_query('Budget "a  phrase" talk ""') == Query(("budget", "talk"), ("a  phrase",))
    assert parse_query('"only"') == Query((), ("only",))


def test_hits_and_json(spark, cues):
    table = render.hits(search.search(cues, Query(("budget",))), F.lit("2026-06-01").cast("date"))
    found = table.collect()
    by = {r.meta_path: r for r in found}
    assert by["m1"].jump_url == "http://p?x=1&time=1" and by["m2"].jump_url == "http://q#3" and by["m3"].jump_url == ""
    assert (by["m1"].days_since_meeting, by["m2"].days_since_meeting, by["m3"].days_since_meeting) == (17, 57, None)
    lines = [json.loads(r.value) for r in render.json_lines(table).collect()]
    assert {x["speaker_group"] for x in lines} == {None}
    assert any(" *" in r.value for r in render.hit_lines(table).collect())


def test_speaker_as_of(spark):
    speakers = [(200.0, "B", ""), (100.0, "A", "g"), (500.0, "C", ""), (500.0, "D", "")]
    rows = [(t, speakers) for t in (50.0, 100.0, 199.9, 200.0, 600.0)] + [(5.0, []), (5.0, None)]
    df = spark.createDataFrame(rows, f"t double, s {SPEAKERS}").select(at.speaker_at(F.col("s"), F.col("t"))["name"].alias("n"))
    assert [r.n for r in df.collect()] == ["A", "A", "A", "B", "D", None, None]


def test_interval_join(spark):
    cue = spark.createDataFrame([("m", 1.0, 1, "early"), ("m", 10.0, 2, "x"), ("m", 12.0, 3, "y"), ("m", 30.0, 4, "z")], "m string, t double, i int, text string")
    sp = spark.createDataFrame([("m", 10.0, "A"), ("m", 20.0, "B"), ("m", 30.0, "C")], "m string, t double, who string")
    got = {r.who: (r.n_cues, r.text) for r in at.interval_groups(cue, sp, "m", "t", "who", "text", "i").collect()}
    assert got == {"A": (2, "x y"), "B": (0, ""), "C": (1, "z")}


def test_rolling_fold(spark):
    base = "abcdefghij"
    cue = lambda i, t: (float(i), float(i + 1), t)
    fold = lambda *texts: [(r.start, r.end, r.text) for r in one(spark, at.without_rolling, [cue(i, t) for i, t in enumerate(texts)], CUE)]
    assert fold(base, base) == [(0.0, 2.0, base)]
    assert [x[2] for x in fold("one two three", "two three、 four", "three、 four five six")] == ["one two three", "four", "three、 four five six"]
    assert [x[2] for x in fold("xx" + base[:6], base[:6] + "yy")] == ["xx" + base[:6], "yy"]
    assert [x[2] for x in fold("xx" + base[:5], base[:5] + "yy")] == ["xx" + base[:5], base[:5] + "yy"]
    long = "".join(chr(0x4E00 + i) for i in range(201))
    assert [x[2] for x in fold("q" + long[:200], long[:200] + "!")] == ["q" + long[:200], "!"]
    assert len(fold("q" + long, long + "!")) == 2 and fold("q" + long, long + "!")[1][2] == long + "!"
    assert [x[2] for x in fold("start here", "t here. ")] == ["start here"] and fold() == []


def test_sentences(spark):
    cue = lambda i, t: (float(i), float(i + 1), t)
    got = one(spark, at.merged_sentences, [cue(0, "この 法律"), cue(1, "を思い"), cue(2, "ます"), cue(3, "また委員"), cue(4, "です。"), cue(5, "終")], CUE)
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 3.0, "この法律を思います。"), (3.0, 5.0, "また、委員です。"), (5.0, 6.0, "終。")]
    assert one(spark, at.merged_sentences, [], CUE) == []
    assert one(spark, tx.punctuated, "審議いたしましたなお政府が") == "審議いたしました。なお、政府が。"


def test_loops_and_invented_phrases(spark):
    loop, tail = "ティ" * 200, "ティ" * 200 + "終わり"
    clean = many(spark, tx.without_loops, [loop, "AIセーフ" + "ティ" * 12 + "他社", "ハハハ", ""])
    assert clean == [tx.UNCLEAR, f"AIセーフ{tx.UNCLEAR}他社", "ハハハ", ""]
    texts = [loop, tail, "ご視聴ありがとうございました。", "　ご視聴ありがとうございました ご視聴ありがとうございました", "はいはいはい", "はいはい", "普通の発言です", "", "Thank you for watching", "議長、ご清聴ありがとうございました"]
    assert many(spark, tx.is_invented, texts) == [True, False, True, True, True, False, False, False, True, False]


def test_replacement_cascades(spark):
    assert one(spark, lambda c: tx.replaced(c, {"ab": "x", "abc": "ab", "zz": "ab"}), "abc zz") == "x ab"
    assert captions.parse_glossary(["# c", "a → b", "a -> c", "bad", " → d", "k->v -> w"], {"z": "y"}) == {"z": "y", "a": "c", "k": "v -> w"}


def test_dates_ids_and_formats(spark):
    day = datetime.date(2026, 4, 5)
    assert many(spark, tx.any_date, ["2026-4-5", "2026/04/05", "20260405", "2026年4月5日（月）", "x", ""]) == [day] * 4 + [None, None]
    assert many(spark, tx.normal_date, ["2026年4月5日", " 2026-4-5 ", "", None]) == ["2026-04-05", "2026-4-5", "", ""]
    assert many(spark, tx.house_of, ["8955", "55000", "https://x/shugiin/1", "https://x/sangiin?sid=9", "abc"]) == ["sangiin", "shugiin", "shugiin", "sangiin", None]
    assert many(spark, tx.clock, [0.9, 3661.0, 360000.0], "double") == ["00:00:00", "01:01:01", "100:00:00"]
    assert one(spark, tx.percent_encoded, "予算 a/b~*") == "%E4%BA%88%E7%AE%97%20a/b~%2A"
    assert one(spark, tx.safe_name, 'a　b:c/"d"') == "a_bcd"
    assert many(spark, tx.role_class, ["_return", "副委員長", "政府参考人", "財務大臣", "会員"]) == ["questioner", "chair", "bureaucrat", "minister", "other"]
    assert one(spark, lambda c: tx.word_break_tokens(c), "成年後見の制度") is not None


def test_pages(spark):
    upper = "<dt>日付</dt><dd> 2026年5月15日 </dd><h3>発言者一覧</h3><ul><a href='#30.5'>乙 （会派）</a><a href=\"#10\">甲(議長)</a></ul> url:\"https://v/x.m3u8?k\""
    got = one(spark, lambda c: tx.speaker_links(c, tx.UPPER_SPEAKER, False), upper)
    assert [(s.start, s["name"], s.group) for s in got] == [(10.0, "甲", "議長"), (30.5, "乙", "会派")]
    assert one(spark, lambda c: tx.labelled_value(c, "日付"), upper) == "2026年5月15日" and one(spark, tx.stream_url, upper) == "https://v/x.m3u8?k"
    lower = 'time=5.0">はじめから再生</a> time=9.01">丙(党)</a> time=9.04">丙(党)</a> time=7">丁</a><td a>予算委員会 (2時間)</td><TD width="595" h bgcolor="#CCCCFF"><IMG>財政 <b>法案</b></TD>'
    got = one(spark, lambda c: tx.speaker_links(c, tx.LOWER_SPEAKER, True), lower)
    assert [(s.start, s["name"], s.group) for s in got] == [(7.0, "丁", ""), (9.01, "丙", "党")]
    assert one(spark, tx.meeting_name, lower) == "予算委員会" and one(spark, tx.agenda_items, lower) == ["財政 法案"]
    assert one(spark, tx.first_date, "は2026年5月1日") == "2026-05-01" and one(spark, tx.first_date, "なし") == ""
    assert one(spark, tx.proper_nouns, ["安全保障の確保（221国会閣30）", "安全保障とセンター"], "array<string>") == ["安全保障", "センター"]
    master = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,URI="a"\n#EXT-X-MEDIA:TYPE=SUBTITLES,URI="s.m3u8"\n'
    assert many(spark, captions.subtitle_playlist, [master, "#EXTM3U"]) == ["s.m3u8", None]


VTT = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nhello\nworld\n\n\nNOTE x\n\n00:00:01.020 --> 00:00:03.000\nhello world\n\n00:05.000 --> 00:06.000\nodd time\n\n00:00:09.000 --> 00:00:10.000\n \n"


def test_captions(spark):
    plain = [(r.start, r.end, r.text) for r in one(spark, captions.caption_cues, VTT)]
    assert plain == [(1.0, 2.5, "hello world"), (1.02, 3.0, "hello world"), (0.0, 0.0, "odd time")]
    assert [(r.start, r.text) for r in one(spark, captions.page_cues, VTT)] == [(0.0, "odd time"), (1.0, "hello world")]
    assert one(spark, captions.caption_text, VTT) == "odd time\nhello world"


def test_corpus_directory_and_tokens(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
    put("2026-05-01_A_参1.vtt", VTT)
    put("2026-05-01_A_参1.meta.json", {"house": "sangiin", "id": 1, "date": "2026-05-01", "title": "A", "page_url": "u", "speakers": [{"start": 0.5, "name": "甲", "group": "g"}], "files": {"vtt": "x/2026-05-01_A_参1.vtt"}})
    put("2026-05-02_B_衆2.vtt", VTT)  # named by no metadata
    put("orphan.meta.json", {"house": "sangiin", "id": "3", "title": "O", "files": {}})
    put("orphan.vtt", VTT)  # hidden by the metadata of its name
    put("bad.meta.json", "{not json")
    put("2026-05-03_C_衆4_transcript.json", {"deli_id": "4", "title": "C", "date": "2026-05-03", "cues": [{"start": 1, "end": 2, "text": "t"}, {"start": 2, "end": 3, "text": ""}, {"text": "u"}]})
    rows = captions.read_cues(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.title, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"A": 3, "B": 3, "C": 2}
    assert {r.speaker_name for r in by["A"]} == {"甲"} and {r.speaker_name for r in by["B"]} == {None} and by["A"][0].id == "1"
    assert by["B"][0].date == "2026-05-02" and sorted((r.cue_idx, r.start) for r in by["C"]) == [(0, 1.0), (1, 0.0)]

    files = captions.read_captions(spark, str(tmp_path)).select("path", "mtime", "cues")
    first = tokens.refreshed(files, None)
    first.write.parquet(str(tmp_path / "t1"))
    kept = spark.read.parquet(str(tmp_path / "t1"))
    assert kept.count() == 9 and not tokens.changed(files, kept) and tokens.changed(files, kept, "2")
    put("new.vtt", VTT)
    (tmp_path / "orphan.vtt").unlink()
    files = captions.read_captions(spark, str(tmp_path)).select("path", "mtime", "cues")
    assert tokens.changed(files, kept)
    names = {r.path.rsplit("/", 1)[1] for r in tokens.refreshed(files, kept).select("path").distinct().collect()}
    assert len(names) == 3 and "new.vtt" in names and "orphan.vtt" not in names

    stream = lambda: tokens.write_stream(tokens.caption_stream(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stream()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    put("later.vtt", VTT)
    stream()
    assert (n, spark.read.parquet(str(tmp_path / "out")).count()) == (9, 12)


def test_catalogue(spark):
    t = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    got = sorted((r.id, r.priority) for r in catalog.by_priority([t("a", "a"), t("a", "b"), t("b", "c", "c")], "id").collect())
    assert got == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, text string")
    patch = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (2, "y", 1), (3, "", 1), (9, "n", 1)], "id int, new_text string, seq int")
    assert sorted((r.id, r.text, r.changed) for r in catalog.patched(rows, patch, "id", "text", "seq").collect()) == [(1, "q", True), (2, "y", False), (3, "z", False)]
    assert catalog.calendar(spark, "2026-01-05", "2026-01-01").count() == 5 and catalog.calendar(spark, "2025-01-01", "2026-01-01").count() == 61
    status = catalog.with_status(t("a", "b"), spark.createDataFrame([("a", "p2"), ("a", "p1")], "id string, path string"), ["id"])
    assert sorted((r.id, r.fetched) for r in status.collect()) == [("a", True), ("b", False)]
