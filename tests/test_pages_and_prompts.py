"""Listings, rosters, responses, prompts and turns on small fixtures."""

from pyspark.sql import functions as F

from columns import SPEAKERS, many, one
from veloquy.operators import attribution as at
from veloquy.operators import prompts
from veloquy.sources import pages


def test_listings(spark):
    row = lambda i, t: f'<A href="?deli_id={i}&m">{t}</A><TD CLASS="x"></TD><TD class="s14_24">1時間</TD>'
    html = row(1, "予算委員会") + row(2, "記者会見") + row(1, "予算委員会") + row(3, " 本会議 ")
    assert [(r.id, r.title, r.duration) for r in one(spark, pages.daily_listing, html)] == [("1", "予算委員会", "1時間"), ("3", "本会議", "1時間")]
    assert [(r.id, r.title) for r in one(spark, pages.live_listing, '<a href="d?sid=77">内閣委員会</a><a href="d?sid=78">その他</a>')] == [("77", "内閣委員会")]
    cell = lambda t, d: f"<td class=' clickable' title=\"{t}\">\n<a href='#' name=\"{d}\">1</a></td>"
    month = spark.createDataFrame([(cell("甲\n乙", "2026-05-01") + cell("丙", "2026-05-02") + cell("丁", "2026-05-01") + cell(" ", "2026-05-03"),)], "html string")
    titles = pages.calendar_titles(month)
    assert sorted(map(tuple, titles.collect())) == [("2026-05-01", "丁"), ("2026-05-02", "丙")]
    live = spark.createDataFrame([("2026-05-02", "丙", "9")], "date string, title string, id string")
    known = spark.createDataFrame([("2026-05-01", "丁", 5, True), ("2026-05-02", "丙", 6, True), ("2026-05-01", "丁", 8, False)], "date string, name string, sid int, valid boolean")
    assert sorted(map(tuple, pages.with_ids(titles, live, known).collect())) == [("2026-05-01", "丁", "5"), ("2026-05-02", "丙", "9")]


def test_roster(spark):
    cell = lambda i, t: f'<TD class="shu2td{i}">\n<TT>{t}\n</TT></TD>'
    html = cell(5, "氏名") + cell(6, "ふりがな") + cell(7, "選挙区") + cell(5, "逢　　一郎君") + cell(6, "あい  いちろう") + cell(7, "岡山1") + cell(5, "余り君")
    got = one(spark, pages.members, html)
    assert [tuple(r) for r in got] == [("逢一郎", "逢　　一郎", "あい いちろう", "岡山1")]
    assert [(r.code, r["name"]) for r in one(spark, pages.factions, '<A HREF="120kaiha.htm">甲</A><A HREF="120kaiha.htm">乙</A><A HREF="130kaiha.htm">丙</A>')] == [("120", "甲"), ("130", "丙")]


def test_responses(spark):
    raw = ['{"corrections":[{"id":1,"text":"a"},{"id":2}]}', '```json\n[{"id":3,"text":"b"}]\n```', "not json", "", '{"other":1}']
    assert [[(r.id, r.text) for r in x] for x in many(spark, pages.corrections, raw)] == [[(1, "a")], [(3, "b")], [], [], []]
    raw = ['{"terms":["x","","y"]}', '["z"]', "no", '{"terms":' + str([str(i) for i in range(20)]).replace("'", '"') + "}"]
    assert many(spark, pages.terms, raw) == [["x", "y"], ["z"], [], [str(i) for i in range(10)]]


def test_prompt(spark):
    speakers = [(1.0, "甲", "党"), (2.0, "乙", "予算委員長"), (3.0, "甲", "党"), (4.0, "丙", "会")]
    df = spark.createDataFrame([("m", "委員会", "2026-05-01", speakers, ["安全保障の確保"])], f"k string, title string, date string, speakers {SPEAKERS}, agenda array<string>")
    members = spark.createDataFrame([(f"党員{i}", "党", i) for i in range(5)] + [("甲", "党", -1), ("会員", "会", 0)], "name string, faction string, roster int")
    related = prompts.colleagues(df, members, "k")
    assert related.first().names == ["党員0", "党員1", "党員2", "会員"]
    row = df.join(related, "k").select(prompts.tiers(F.col("title"), F.col("date"), F.col("speakers"), F.col("agenda"), F.col("names")).alias("t")).first().t
    assert row[:5] == ["委員会（2026-05-01）。", "発言者: 甲、乙、丙。", "会派: 党、会。", "議題: 安全保障。", "関連議員: 党員0、党員1、党員2、会員。"] and len(row) == 6
    assert one(spark, lambda c: prompts.within(c, 5), ["abc", "de", "f"], "array<string>") == "abc\nde" and one(spark, lambda c: prompts.within(c, 2), ["abc"], "array<string>") == ""
    assert one(spark, lambda c: prompts.with_terms(F.lit("予算と"), c, 8), ["予算", "道路", "橋"], "array<string>") == "予算と 道路、橋"


def test_turns(spark):
    text = "前置き 田中大臣 答えます 山田君 続けます"
    calls = [("田中", "大臣", 4), ("山田", "_return", 14)]
    df = spark.createDataFrame([("s", text, "山田", calls), ("t", "全部", "山田", None)], "k string, text string, who string, calls array<struct<name: string, role_str: string, start: int>>")
    got = prompts.turns(df, "k", "text", "who", "calls")
    assert sorted((r.k, r["at"], r.speaker, r.klass, r.text) for r in got.collect()) == [
        ("s", 0, "山田", "questioner", "前置き"), ("s", 1, "田中", "minister", "田中大臣 答えます"), ("s", 2, "山田", "questioner", "山田君 続けます"), ("t", 0, "山田", "questioner", "全部"),
    ]
    assert at.runs(got, "k", "at", ["speaker", "klass"], "text").count() == 4


def test_summary_and_pending(spark):
    kind = "struct<phase: string, live: boolean, asr_backend: string, asr_model: string, hint: string, hint_chars: int, preclean_hallucinations: int, preclean_loops: int, glossary: boolean, glossary_changes: int, llm_context: boolean, llm_context_terms: array<string>, llm_correct: boolean, llm_correct_changes: int>"
    asr = ("asr", False, "fw", None, "h", 12, 2, 0, True, 3, False, None, False, None)
    rows = spark.createDataFrame([("1", asr), ("2", ("vtt", True, *[None] * 12)), ("", ("vtt", True, *[None] * 12)), ("4", None)], f"id string, pipeline {kind}")
    got = {r.id: r.s for r in rows.select("id", prompts.summary().alias("s")).collect()}
    assert got["1"] == "ASR: fw / ?・hint 12字注入・preclean 幻覚 2 件・glossary 3 箇所・LLM 校正なし" and got["2"] == "公式 VTT 字幕" and got["4"] == ""
    assert [r.id for r in prompts.pending(rows).collect()] == ["2"]
