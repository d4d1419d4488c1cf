"""Readers of a corpus directory: caption files, transcripts, meeting metadata, glossaries.

Every reader lists and reads files through Spark, so a path may be in any store Spark knows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquy.functions.text import LOWER_HOUSE, UPPER_HOUSE, first_of_each, joined_url
from veloquy.operators.attribution import by_start, speaker_at, without_rolling

SPEAKERS = "array<struct<start: double, name: string, group: string>>"
META = (
    f"house string, id string, date string, title string, page_url string, speakers {SPEAKERS}, files struct<vtt: string, text: string, html: string, transcript: string>, "
    "pipeline struct<phase: string, live: boolean>, generated_at string, agenda array<string>"
)
TRANSCRIPT = "deli_id string, title string, date string, hint string, cues array<struct<start: double, end: double, text: string>>"
CUE = "array<struct<start: double, end: double, text: string>>"
# First words of caption blocks that hold no cue.
NO_CUE = ("WEBVTT", "NOTE", "STYLE", "REGION", "X-TIMESTAMP-MAP")


def seconds(stamp: Column) -> Column:
    """`H:MM:SS.mmm` as seconds, anything else as 0."""
    form = r"^([0-9]+):([0-9]{2}):([0-9]{2})\.([0-9]{3})"
    part = lambda i: F.regexp_extract(stamp, form, i).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000, F.lit(0.0))


def caption_cues(text: Column) -> Column:
    """array<struct<start, end, text>> of a caption file in file order; blocks without text or
    times are left out."""
    blocks = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n+")
    lines = F.transform(blocks, lambda b: F.filter(F.split(b, "\n"), lambda x: F.btrim(x) != ""))
    lines = F.filter(lines, lambda x: (F.size(x) > 0) & ~F.element_at(x, 1).rlike("^(" + "|".join(NO_CUE) + ")"))
    lines = F.transform(lines, lambda x: F.when(~F.element_at(x, 1).contains("-->"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x))
    lines = F.filter(lines, lambda x: F.coalesce(F.try_element_at(x, F.lit(1)).contains("-->"), F.lit(False)))
    form = r"^\s*(\S+)\s*-->\s*(\S+)"
    cues = F.transform(lines, lambda x: F.struct(seconds(F.regexp_extract(F.element_at(x, 1), form, 1)).alias("start"), seconds(F.regexp_extract(F.element_at(x, 1), form, 2)).alias("end"), F.btrim(F.array_join(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), " ")).alias("text")))
    return F.filter(cues, lambda c: c.text != "")


def page_cues(text: Column) -> Column:
    """As `caption_cues`, without repeats of (start to a tenth, text), by start, rolling undone.

    Starts are compared by whole tenths of a second, halves up."""
    cues = F.transform(caption_cues(text), lambda c, i: F.struct(c.start.alias("start"), i.alias("ord"), c.end.alias("end"), c.text.alias("text")))
    tenth = lambda c: F.floor(F.round(c.start * 1000) / 100 + 0.5)
    once = first_of_each(cues, lambda c: F.struct(tenth(c), c.text))
    ordered = F.transform(F.array_sort(once), lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.text.alias("text")))
    return without_rolling(ordered)


def caption_text(text: Column) -> Column:
    return F.array_join(F.transform(page_cues(text), lambda c: c.text), "\n")


def subtitle_playlist(master: Column, address: Column | None = None) -> Column:
    """URI of the first subtitle track of a master playlist, as it stands at `address` if that is
    given; null without one."""
    found = F.nullif(F.regexp_extract(master, r'(?m)^#EXT-X-MEDIA(?=.*TYPE=SUBTITLES).*?URI="([^"]+)"', 1), F.lit(""))
    return found if address is None else joined_url(address, found)


def file_base(path: Column, ending: str) -> Column:
    name = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, re.escape(ending) + "$", "")


def parsed_base(base: Column) -> tuple[Column, Column]:
    """(date, title) from a file's base name: `date_title` with or without an id behind."""
    form = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)_(.+?)(?:_(?:衆|参|shugiin|sangiin|deli)[0-9]+)?$"
    has = base.rlike(form)
    return F.when(has, F.regexp_extract(base, form, 1)).otherwise(""), F.when(has, F.regexp_extract(base, form, 2)).otherwise(base)


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))


def _parsed_meta(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    rows = _files(spark, folder, "*.meta.json").withColumn("meta", F.from_json("content", META, {"mode": "PERMISSIVE"}))
    return rows, F.col("meta").isNotNull() & F.coalesce("meta.house", "meta.id", "meta.title").isNotNull()


def unreadable_meta(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the `*.meta.json` that `read_meta` leaves out, to be warned of."""
    rows, readable = _parsed_meta(spark, folder)
    return rows.filter(~F.coalesce(readable, F.lit(False))).select("path")


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each readable `*.meta.json`; unreadable ones are left out."""
    rows, readable = _parsed_meta(spark, folder)
    rows = rows.filter(readable)
    return rows.select("path", "mtime", file_base(F.col("path"), ".meta.json").alias("base"), "meta.*")


def read_captions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _files(spark, folder, "*.vtt")
    return rows.select("path", "mtime", file_base(F.col("path"), ".vtt").alias("base"), caption_cues(F.col("content")).alias("cues"))


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _files(spark, folder, "*_transcript.json").withColumn("t", F.from_json("content", TRANSCRIPT, {"mode": "PERMISSIVE"}))
    cues = F.filter(F.coalesce("t.cues", F.array().cast(CUE)), lambda c: F.coalesce(c.text, F.lit("")) != "")
    cues = F.transform(cues, lambda c: F.struct(F.coalesce(c.start, F.lit(0.0)).alias("start"), c.end.alias("end"), c.text.alias("text")))
    return rows.select("path", "mtime", file_base(F.col("path"), "_transcript.json").alias("base"), "t.deli_id", "t.title", "t.date", cues.alias("cues"))


def _last_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_cues(spark: SparkSession, folder: str) -> DataFrame:
    """All cues of a corpus directory, with speaker, source order and position.

    Three tiers: meetings with metadata (transcript if it is there, else captions), then caption
    files without metadata of their name, then transcripts likewise."""
    meta, captions, transcripts = (f(spark, folder) for f in (read_meta, read_captions, read_transcripts))
    wanted_t, wanted_v = _last_name(F.col("files.transcript")), _last_name(F.col("files.vtt"))
    t = transcripts.select(F.concat("base", F.lit("_transcript.json")).alias("t_name"), F.col("cues").alias("t_cues"))
    v = captions.select(F.concat("base", F.lit(".vtt")).alias("v_name"), F.col("cues").alias("v_cues"))
    first = meta.withColumn("t_name", wanted_t).withColumn("v_name", wanted_v).join(t, "t_name", "left").join(v, "v_name", "left")
    first = first.filter(F.coalesce("t_cues", "v_cues").isNotNull()).select(F.lit(1).alias("tier"), "path", "house", "id", "date", "title", F.coalesce("page_url", F.lit("")).alias("page_url"), "speakers", F.coalesce("t_cues", "v_cues").alias("cues"))
    none = F.array().cast(SPEAKERS)
    bare = captions.join(meta.select("base"), "base", "left_anti")
    date, title = parsed_base(F.col("base"))
    second = bare.select(F.lit(2).alias("tier"), "path", F.lit(UPPER_HOUSE).alias("house"), F.lit("").alias("id"), date.alias("date"), title.alias("title"), F.lit("").alias("page_url"), none.alias("speakers"), "cues")
    seen = meta.select("base").unionByName(captions.select("base"))
    third = transcripts.join(seen, "base", "left_anti")
    date, title = parsed_base(F.col("base"))
    third = third.select(F.lit(3).alias("tier"), "path", F.lit(LOWER_HOUSE).alias("house"), F.coalesce("deli_id", F.lit("")).alias("id"), F.coalesce(third["date"], date).alias("date"), F.coalesce(third["title"], title).alias("title"), F.lit("").alias("page_url"), none.alias("speakers"), "cues")
    rows = first.unionByName(second).unionByName(third)
    rows = rows.withColumn("speakers", by_start(F.coalesce("speakers", none)))
    each = rows.select("tier", "path", "house", "id", "date", "title", "page_url", "speakers", F.posexplode("cues").alias("cue_idx", "cue"))
    speaker = speaker_at(F.col("speakers"), F.col("cue.start"), ordered=True)
    return each.select(F.struct("tier", "path").alias("src_ord"), "house", "id", "date", "title", "page_url", "cue_idx", "cue.start", "cue.end", "cue.text", speaker["name"].alias("speaker_name"), speaker["group"].alias("speaker_group"), F.col("path").alias("meta_path"))


# What recognisers make of frequent words, and the words.
DEFAULT_GLOSSARY = {
    "前回一致": "全会一致", "不対決議": "附帯決議", "規律多数": "起立多数", "規律を求めます": "起立を求めます", "起立を求めます。規律": "起立を求めます。起立",
    "委員長報酷": "委員長報告", "報酷": "報告", "时代となりました": "議題となりました", "时代となります": "議題となります", "一定第": "日程第", "の报告": "の報告",
    "青年貢献": "成年後見", "自理を弁識": "事理を弁識", "公権及び補佐": "後見及び保佐", "公権開始": "後見開始", "補佐開始": "保佐開始", "補助開始の審刊": "補助開始の審判",
    "の審刊": "の審判", "応印要件": "押印要件", "に閣する": "に関する", "任意貢献契約": "任意後見契約", "任意貢権監督人": "任意後見監督人", "任意貢監督人": "任意後見監督人",
    "貢献登記": "後見登記", "貢献開始": "後見開始", "法廷の重要な財産": "法定の重要な財産", "御異義なし": "御異議なし",
    "体内直接投資": "対内直接投資", "体内直接投信": "対内直接投資", "财务金優": "財務金融", "财务金融": "財務金融", "財務金優": "財務金融",
    "携帰音声通信": "携帯音声通信", "携帰": "携帯", "電気通信駅務": "電気通信役務", "電気通信駆務": "電気通信役務", "電気通信益務": "電気通信役務", "電気通信駅": "電気通信役",
    "音声通信駅務": "音声通信役務", "益務を提供": "役務を提供", "新政英": "生成 AI",
}


def read_glossary(spark: SparkSession, path: str | None = None, include_defaults: bool = True) -> dict[str, str]:
    """The default entries and those of a file (a few lines, read on the driver), which win."""
    lines = [r.value for r in spark.read.text(path).collect()] if path else []
    return parse_glossary(lines, DEFAULT_GLOSSARY if include_defaults else None)


def parse_glossary(lines: list[str], base: dict[str, str] | None = None) -> dict[str, str]:
    """`wrong → right` or `wrong -> right` a line; `#` starts a comment line; later lines win."""
    out = dict(base or {})
    for line in map(str.strip, lines):
        pair = [p.strip() for p in re.split("→|->", line, maxsplit=1)]
        if line[:1] != "#" and len(pair) == 2 and all(pair):
            out[pair[0]] = pair[1]
    return out


def kept_members(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame], now: datetime, days: int = 7, refresh: bool = False) -> DataFrame:
    """The roster stored at `path`; made anew by `rebuild` if it is missing, unreadable, older than
    `days`, or if asked."""
    if not refresh:
        try:
            table = spark.read.parquet(path)
            written = table.select(F.max(F.unix_micros("_metadata.file_modification_time"))).first()[0]
        except (AnalysisException, Py4JJavaError):
            written = None
        if written is not None and written / 1e6 >= now.timestamp() - days * 86400:
            return table
    rebuild().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_pages(spark: SparkSession, folder: str, glob: str = "*.html", encoding: str = "utf-8") -> DataFrame:
    """(path, html) of downloaded pages in any encoding; bytes that don't fit become U+FFFD."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(encoding, "replace"))

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", decoded("content").alias("html"))
