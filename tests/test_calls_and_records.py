"""Speaker calls, addresses, ranges, records, roster cache and encodings on small fixtures."""

import datetime
import json
import os
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from columns import SPEAKERS, many, one
from veloquy.functions import calls
from veloquy.functions import text as tx
from veloquy.operators import catalog, prompts, render
from veloquy.plans import registry
from veloquy.sources import captions, pages

NAMES = ["山本", "三浦", "阿部", "木原", "山口", "榊原", "鈴木花子", "高橋桃子", "鈴木", "今", "先", None, ""]


def found(spark, texts, names=NAMES):
    df = spark.createDataFrame([(i, t, names) for i, t in enumerate(texts)], "i int, t string, n array<string>")
    rows = df.select("i", calls.speaker_calls(F.col("t"), F.col("n")).alias("c")).orderBy("i").collect()
    return [[(c["name"], c.role_str, c.start) for c in r.c] for r in rows]


def test_calls(spark):
    texts = [
        "山本大臣まずですね、お答えします。", "山本デジタル大臣まず。", "三浦統括監はい、お答えします。", "木原官房長官お答えします。", "山口最高裁長官です。",
        "厚生労働省大臣官房榊原審議官お答えいたします。", "鈴木花子くん。ありがとう。", "ええ。山本総括審議官にお願いします。山本総括審議官はい。", "高橋桃子君次です。",
    ]
    assert found(spark, texts) == [
        [("山本", "大臣", 0)], [("山本", "デジタル大臣", 0)], [("三浦", "統括監", 0)], [("木原", "官房長官", 0)], [("山口", "最高裁長官", 0)],
        [("榊原", "審議官", 9)], [("鈴木花子", "_return", 0)], [("山本", "総括審議官", 18)], [("高橋桃子", "_return", 0)],
    ]


def test_mentions_and_others_are_no_calls(spark):
    texts = ["山本大臣に伺います。", "山本大臣のお考えは。", "山本大臣は素晴らしい。", "山本大臣が答弁した。", "山本大臣を呼んだ。", "三浦統括監への質問です。", "今の大臣の答弁。", "先大臣お願い。", "中原局長お答えします。", "山本、大臣お答え。", "", None]
    assert found(spark, texts) == [[]] * len(texts)
    assert found(spark, ["山本大臣お答えします。"], []) == [[]] and found(spark, ["山本大臣お答えします。"], None) == [[]]


LONG = "山田国土交通省総合政策局長お答えします。ええ。阿部こども家庭庁長官はい。山本さんが昨日申し上げた件について大臣。木原内閣府特命担当大臣。"


def by_roster(spark, texts, names=NAMES):
    rows = calls.roster_calls(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", spark.createDataFrame([(n,) for n in names], "name string"))
    return [[(c["name"], c.role_str, c.start) for c in r.calls] for r in rows.orderBy("i").collect()]


def test_titles_of_any_length_and_names_in_a_row(spark):
    names = [*NAMES, "山田", "太郎"]
    want = [("山田", "国土交通省総合政策局長", 0), ("阿部", "こども家庭庁長官", LONG.index("阿部")), ("木原", "内閣府特命担当大臣", LONG.index("木原"))]
    texts = [LONG, "山田太郎財務大臣お答え。", "先。山田君。"]
    for find in (found, by_roster):
        assert find(spark, texts, names) == [want, [("山田太郎", "財務大臣", 0)], [("山田", "_return", 2)]]


def test_one_automaton_finds_what_the_lists_find(spark):
    rnd = random.Random(2)
    parts = ["山本", "三浦", "鈴木", "花子", "大臣", "審議官", "君", "氏", "、", "。", "の", "に", "はい", "は", "と", "ところ", "デジタル", "総合政策", "局長", "今", "ABC", " "]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(1, 14))) for _ in range(400)]
    names = ["山本", "三浦", "鈴木", "花子", "鈴木花子"]
    assert by_roster(spark, texts, names) == found(spark, texts, names)
    assert by_roster(spark, [None, "", "山本大臣お答え"], []) == [[], [], []]


def test_long_texts_are_cut_at_sentences(spark):
    body = "これは長い文です。" * 3000
    text = body + "山本大臣お答えします。" + body + "三浦統括監はい。"
    assert len(body.encode()) > 2 * calls.MOST_BYTES
    assert by_roster(spark, [text]) == [[("山本", "大臣", len(body)), ("三浦", "統括監", 2 * len(body) + 11)]]
    pieces = list(calls._pieces(text))
    assert "".join(p for _, p in pieces) == text and all(len(p.encode()) <= calls.MOST_BYTES and text.startswith(p, i) for i, p in pieces)
    assert "".join(p for _, p in calls._pieces("あ" * 30_000)) == "あ" * 30_000


def test_neighbours_of_one_speaker_are_one_turn(spark):
    rows = spark.createDataFrame([(1, "伺います。山本大臣お答えします。山本大臣続けます。鈴木花子君次に。", "鈴木花子", "甲党"), (2, "山本大臣どうぞ。", "鈴木花子", "甲党"), (3, "何もない。", "鈴木花子", "甲党"), (4, "", "x", None)], "k int, t string, p string, g string")
    called = rows.withColumn("c", calls.speaker_calls(F.col("t"), F.array(*map(F.lit, ["山本", "鈴木花子"]))))
    got = prompts.merged_turns(prompts.turns(called, "k", "t", "p", "c", "g"), "k").orderBy("k", "at").collect()
    assert [(r.k, r.speaker, r.klass, r.role, r.group, r.text) for r in got] == [
        (1, "鈴木花子", "questioner", "議員", "甲党", "伺います。"), (1, "山本", "minister", "大臣", "", "山本大臣お答えします。 山本大臣続けます。"), (1, "鈴木花子", "questioner", "議員", "", "鈴木花子君次に。"),
        (2, "山本", "minister", "大臣", "", "山本大臣どうぞ。"), (3, "鈴木花子", "questioner", "議員", "甲党", "何もない。"),
    ]


def test_listing_to_read(spark):
    rows = [("2026-05-15", "shugiin", "7", "予算委員会", "2時間", True, "u7"), ("2026-05-15", "sangiin", None, "本会議", None, None, None), ("x", "sangiin", "3", "t", "", False, "u3")]
    items = spark.createDataFrame(rows, "date string, house string, id string, title string, duration string, fetched boolean, page_url string")
    assert [r.value for r in render.listing_text(items).collect()] == [
        "[3 件]", "── 2026-05-15 (金) ──", "  [参議院] 本会議", "    id=?", "    ", "  [衆議院] 予算委員会 / 2時間 ✓ 取込済", "    id=7  fetch 7", "    u7", "── x (?) ──", "  [参議院] t", "    id=3  fetch 3", "    u3",
    ]
    lines = [json.loads(r.value) for r in render.listing_json_lines(items).collect()]
    assert lines[0] == {"type": "summary", "n_items": 3} and len(lines) == 4 and lines[1]["type"] == "item" and lines[1]["title"] == "予算委員会"
    assert [r.value for r in render.listing_text(items.limit(0)).collect()] == ["[0 件]"]


def test_days_since_two_spellings_as_a_beginning(spark):
    texts = ["2026-05-01 (金)", "2026年5月1日", "2026-5-1", "20260501", "2026/5/1", "2026-13-01", " 2026-05-01", "", None]
    assert many(spark, lambda c: tx.days_since(c, F.lit("2026-05-11").cast("date")), texts) == [10, 10, 10, None, None, None, None, None, None]


def test_roles_classes_and_chunks(spark):
    assert many(spark, calls.ends_in_role, ["総括審議官", "局長、大臣", "大臣は"]) == [True, False, False]
    assert many(spark, calls.page_class, ["予算委員長", "甲党", None]) == ["chair", "questioner", "questioner"]
    text = "あいう。" * 5 + "え" * 30 + "\nお"
    got = one(spark, lambda c: calls.chunk_starts(c, 40), text)
    assert "".join(x.text for x in got) == text and all(len(x.text.encode()) <= 40 and text[x.start :].startswith(x.text) for x in got)
    assert [x.start for x in got][:2] == [0, 12] and one(spark, calls.chunk_starts, "") == []


def test_addresses(spark):
    bases = ["http://a.b/c/d;p?q#f", "https://a.b", "http://a.b/c/"]
    refs = ["g", "./g", "g/", "/g", "//h/x", "?y", "#s", "", "../g", "../../g", "../../../g", "https://x/y", "g?y#s", ".", ".."]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for r in df.select("b", "r", tx.joined_url(F.col("b"), F.col("r")).alias("x")).collect():
        if not (r.r == "" or r.r.startswith(("?", "#")) and "#" in r.b):
            assert r.x.replace("a.b/?", "a.b?") == urllib.parse.urljoin(r.b, r.r).replace("a.b/?", "a.b?"), (r.b, r.r)
    assert many(spark, tx.deli_id, [" 123 ", "http://x?deli_id=45&m", "abc", None]) == ["123", "45", None, None]
    page = '<input type="hidden" id="vtag_src_base_vod" value="http://v/http://x.m3u8">'
    assert one(spark, tx.hidden_stream_url, page) == "https://v/http://x.m3u8" and one(spark, tx.hidden_stream_url, "<p>") is None
    assert one(spark, lambda c: captions.subtitle_playlist(c, F.lit("http://m/a/main.m3u8")), '#EXT-X-MEDIA:TYPE=SUBTITLES,URI="s/t.m3u8"') == "http://m/a/s/t.m3u8"
    assert one(spark, tx.html_escaped, "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"


def test_detail_pages(spark):
    html = "<dt>開会日</dt><dd>2026年5月15日</dd><dt> 会議名 </dt><dd> 予算委員会 </dd><a href='#1'>目次</a><h3>発言者一覧</h3><ul><li><a href='#5'>甲(乙党)</a></li></ul><a href='#9'>注</a>"
    df = spark.createDataFrame([(html, 'x{url:"https://v/a.m3u8"}', None), (html, 'url:"",channel_info:{id:1,url:"https://c/d/info.json"}', '{"manifest":"m/x.m3u8"}'), (html, "", None)], "h string, s string, d string")
    got = [r.x for r in df.select(pages.upper_detail(F.col("h"), F.col("s"), F.lit("u"), F.col("d")).alias("x")).collect()]
    assert [(x.m3u8, x.is_live) for x in got] == [("https://v/a.m3u8", False), ("https://c/d/m/x.m3u8", True), (None, False)]
    assert (got[0].date, got[0].title, [(s.start, s["name"], s.group) for s in got[0].speakers]) == ("2026年5月15日", "予算委員会", [(5.0, "甲", "乙党")])
    html = '<td>本会議 (3時間)</td> 2026年5月5日 <A HREF="i?deli_id=9&time=20.0">丙(丁)</a><TD width=595 bgcolor="#ccccff">議題</TD>'
    x = one(spark, lambda c: pages.lower_detail(c, F.lit("9")), html)
    assert (x.deli_id, x.m3u8, x.date, x.title, x.speakers[0].start, x.agenda) == ("9", None, "2026-05-05", "本会議", 20.0, ["議題"])


def test_ranges_suggestions_and_changes(spark):
    day = datetime.date(2026, 5, 20)
    ago = day - datetime.timedelta(days=7)
    assert catalog.listing_range(day) == (ago, day) and catalog.listing_range(day, on=ago, since=day) == (ago, ago)
    assert catalog.listing_range(day, until=ago) == (ago, ago) and catalog.listing_range(day, since=day) == (day, day)
    rows = [("2026-05-01", "s", str(i), f"予算委員会{i}", i == 3) for i in range(14)] + [("2026-05-01", "s", "x", "本会議", None)]
    items = spark.createDataFrame(rows, "date string, house string, id string, title string, fetched boolean")
    got = [r.id for r in catalog.suggestions(items, '"予算" 他').collect()]
    assert len(got) == 10 and "3" not in got and "x" not in got
    assert catalog.suggestions(items, "", 100).count() == 14 and catalog.resolved(items, "id").count() == 15
    files = spark.createDataFrame([("1", "meta"), ("1", "html"), ("1", "html"), ("2", "meta")], "id string, kind string")
    assert {r.id for r in catalog.unfinished(items, files, ["id"], ["meta", "html"]).collect()} == {r[2] for r in rows} - {"1"}
    assert catalog.changes(items, long=F.length("title") > 5, never=F.lit(None).cast("boolean")).first().asDict() == {"long": 14, "never": 0}


def test_blank_keys_are_nobodys(spark):
    items = spark.createDataFrame([("",), ("a",)], "id string")
    fetched = spark.createDataFrame([("", "p"), ("a", "p"), (None, "q")], "id string, path string")
    assert {r.id: r.fetched for r in catalog.with_status(items, fetched, ["id"]).collect()} == {"": False, "a": True}


def test_records(spark, tmp_path):
    rows = spark.createDataFrame(
        [("shugiin", "9", "2026-05-01", None, "u", [(1.0, "甲", None)], ("a.vtt", None), False, ["x"], "9"), ("sangiin", "8", "", "会", "u", None, None, None, [], "")],
        f"house string, id string, date string, title string, page_url string, speakers {SPEAKERS}, files struct<vtt: string, html: string>, is_live boolean, agenda array<string>, deli_id string",
    )
    compact = [json.loads(r.value) for r in render.compact_meta(rows).collect()]
    assert compact == [{"date": "2026-05-01", "deli_id": "9", "speakers": [{"start": 1.0, "name": "甲"}], "agenda": ["x"]}, {"title": "会"}]
    meta = {r.id: json.loads(r.value) for r in render.meta_records(rows, "vtt", F.lit("t")).collect()}
    assert meta["9"]["pipeline"] == {"phase": "vtt"} and meta["9"]["title"] == "" and meta["9"]["files"] == {"vtt": "a.vtt"}
    assert meta["8"]["pipeline"] == {"phase": "vtt", "live": True} and meta["8"]["speakers"] == []
    render.write_records(render.meta_records(rows, "vtt", F.lit("t")), str(tmp_path / "meta"), "house")
    assert json.loads(spark.read.text(str(tmp_path / "meta/house=shugiin")).first().value)["id"] == "9"
    events = [json.loads(r.value) for r in render.speaker_events(rows, "id").collect()]
    assert events == [{"type": "speaker", "i": 0, "start": 1.0, "name": "甲", "group": None}]
    talk = spark.createDataFrame([("9", None, "d", None, [(0.0, 1.0, "a")])], captions.TRANSCRIPT)
    assert json.loads(render.transcript_records(talk).first().value) == {"deli_id": "9", "title": None, "date": "d", "hint": None, "cues": [{"start": 0.0, "end": 1.0, "text": "a"}]}


def test_requests_and_smoke_report(spark):
    cues = spark.createDataFrame([("m", i, f"t{i}") for i in range(9)], "m string, n int, t string")
    got = {r.batch: json.loads(r.value) for r in prompts.correction_requests(cues, "m", "n", "t", F.lit("")).collect()}
    assert [len(got[b]["cues"]) for b in (0, 1)] == [8, 1] and got[1] == {"cues": [{"id": 0, "text": "t8"}]}
    turns = spark.createDataFrame([(1, "甲", "questioner", "議員", "x" * 300), (2, "乙", "minister", "大臣", "y" * 300), (3, "甲", "questioner", "議員", "z")], "s int, speaker string, klass string, role string, text string")
    roles, respondents, silent = prompts.smoke_report(turns, "s", "text", 1)
    assert [tuple(r) for r in roles.collect()] == [("議員", 2)] and [r.speaker for r in respondents.collect()] == ["乙"] and [tuple(r) for r in silent.collect()] == [(1, 300)]


def test_roster_is_kept_for_days(spark, tmp_path):
    path, made = str(tmp_path / "roster"), []

    def rebuild():
        made.append(1)
        return spark.range(len(made))

    now = datetime.datetime.now()
    for at, refresh, times in ((now, False, 1), (now, False, 1), (now + datetime.timedelta(days=8), False, 2), (now, True, 3)):
        table = captions.kept_members(spark, path, rebuild, at, refresh=refresh)
        assert len(made) == times and table.count() == times
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            (tmp_path / "roster" / name).write_bytes(b"broken")
    assert captions.kept_members(spark, path, rebuild, now).count() == 4


def test_pages_in_other_encodings_and_glossaries(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<td>会議</td>".encode("euc_jp"))
    assert pages_of(spark, tmp_path, "euc_jp") == ["<td>会議</td>"]
    (tmp_path / "g.txt").write_text("# x\n携帰 → 形態\nfoo -> bar\n", encoding="utf-8")
    known = captions.read_glossary(spark, str(tmp_path / "g.txt"))
    assert known["携帰"] == "形態" and known["foo"] == "bar" and known["報酷"] == "報告"
    assert captions.read_glossary(spark, str(tmp_path / "g.txt"), False) == {"携帰": "形態", "foo": "bar"} and captions.read_glossary(spark, None, False) == {}


def pages_of(spark, folder, encoding):
    return [r.html for r in captions.read_pages(spark, str(folder), encoding=encoding).collect()]


@pytest.mark.parametrize("least", [500])
def test_sid_pages(spark, least):
    html = "<dt>開会日</dt><dd>2026年5月5日</dd><dt>会議名</dt><dd>甲委員会</dd>"
    df = spark.createDataFrame([(1, html + " " * least), (2, html), (3, " " * least), (4, None)], "sid int, html string")
    got = {r.sid: (r.date, r["name"], r.valid) for r in catalog.sid_pages(df).collect()}
    assert got == {1: ("2026-05-05", "甲委員会", True), 2: ("2026-05-05", "甲委員会", False), 3: ("", "", False)}
    assert catalog.last_known(catalog.sid_pages(df)).first().sid == 1 and [r.sid for r in catalog.ids_on(catalog.sid_pages(df), "2026-05-05").collect()] == [1]


def test_loops_are_counted_and_the_text_is_kept(spark, tmp_path):
    texts = ["はい" + "ああ" * 12 + "です" + "x" * 10, "plain", "ab" * 200, None]
    got = many(spark, tx.loops_out, texts)
    assert [(g.text, g.loops, g.original) for g in got] == [(f"はい{tx.UNCLEAR}です{tx.UNCLEAR}", 2, texts[0]), ("plain", 0, None), (tx.UNCLEAR, 1, texts[2]), (None, 0, None)]
    assert many(spark, lambda c: tx.record_url(c, "q="), ["a b", "", None]) == ["q=a%20b", "", ""]
    (tmp_path / "a.meta.json").write_text("not json")
    (tmp_path / "b.meta.json").write_text('{"house":"h","id":"1","title":"t"}')
    assert [r.path[-11:] for r in captions.unreadable_meta(spark, str(tmp_path)).collect()] == ["a.meta.json"]


def test_places_of_a_listing_in_partitions_of_any_size(spark):
    """Rows and their counts agree on partitions, however these are put together."""
    sizes = {"parallelismFirst": "false", "minPartitionSize": "1k"}
    conf = {f"spark.sql.adaptive.coalescePartitions.{k}": v for k, v in sizes.items()} | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": None}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for size in ("16k", "64k"):
            for k, v in conf.items():
                spark.conf.set(k, v or size)
            rows = registry.listing_text(spark, "/root/testdata/sf0.001").collect()
            rows.sort(key=lambda r: (r.date or "", r.house or "", r.id or "", r.line))
            assert len(rows) == 5595 and [r.place for r in rows] == list(range(1, 5596))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ages_of_all_four_spellings(spark):
    """Only what is spelt in a fifth way has no age."""
    rows = registry.age_in_days(spark, "/root/testdata/sf0.001").collect()
    assert {r.o_orderkey % 5 for r in rows if r.days is not None} == {0, 1, 2, 3}
    assert all((r.days is None) == (r.o_orderkey % 5 == 4) for r in rows)


def test_calls_are_found_once_whatever_reads_them(spark):
    """One Python step for turns and reports, also after filters of their own."""
    for name in ("respondents", "merged_turns"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
