"""Listing, calendar and roster pages, and model responses, as arrays in a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquy.functions import text as tx

_MEETING = "|".join(tx.MEETINGS)
# Class of the cell with a recording's length, labels of a page's date and title,
# classes and heads of roster columns.
LENGTH_CLASS = "s14_24"
ROSTER_CLASS = "shu2td"
DATE_LABEL, TITLE_LABEL = "開会日", "会議名"
ROSTER_HEADS = {"name": ("氏名", "5"), "furigana": ("ふりがな", "6"), "district": ("選挙区", "7")}


def daily_listing(html: Column) -> Column:
    """array<struct<ord, id, title, duration>> of a day's listing; meetings only, first of each id.
    An entry reaches from its link to the next one and has a cell with its length."""

    def entry(part: Column, i: Column) -> Column:
        link = F.try_element_at(tx.elements(part, "a"), F.lit(1))
        cell = F.filter(tx.elements(part, "td"), lambda e: tx.attribute(e.attrs, "class") == LENGTH_CLASS)
        return F.struct(i.alias("ord"), tx.deli_id(tx.attribute(link.attrs, "href")).alias("id"), tx.plain(link.body).alias("title"), tx.plain(F.try_element_at(cell, F.lit(1)).body).alias("duration"))

    rows = F.transform(F.split(html, r"(?i)(?=<a\b[^>]*deli_id=[0-9])"), entry)
    rows = F.filter(rows, lambda x: x.id.isNotNull() & x.title.rlike(_MEETING) & (F.coalesce(x.duration, F.lit("")) != ""))
    kept = tx.first_of_each(rows, lambda x: x.id)
    return F.transform(kept, lambda x, i: F.struct(i.alias("ord"), x.id.alias("id"), x.title.alias("title"), x.duration.alias("duration")))


def live_listing(html: Column) -> Column:
    """array<struct<id, title>> of what is on today."""
    on = F.filter(tx.links(html), lambda x: x.href.rlike("sid=[0-9]") & x.label.rlike(f"^[^<]+(?:{_MEETING})"))
    return F.transform(on, lambda x: F.struct(F.regexp_extract(x.href, "sid=([0-9]+)", 1).alias("id"), F.regexp_extract(x.label, f"^[^<]+(?:{_MEETING})", 0).alias("title")))


def calendar_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """(date, title) of a month's calendar; of cells with one date the last counts."""

    def cell(e: Column) -> Column:
        day = tx.attribute(F.try_element_at(tx.elements(e.body, "a"), F.lit(1)).attrs, "name")
        titles = F.filter(F.transform(F.split(tx.attribute(e.attrs, "title"), "\n"), lambda t: F.btrim(t)), lambda t: t != "")
        return F.struct(day.alias("date"), titles.alias("titles"))

    active = F.filter(tx.elements(F.col(html), "td"), lambda e: F.array_contains(F.split(tx.attribute(e.attrs, "class"), r"\s+"), "clickable"))
    cells = F.filter(F.transform(active, cell), lambda x: x.date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.size(x.titles) > 0))
    last = tx.first_of_each(F.reverse(cells), lambda x: x.date)
    return pages.select(F.explode(last).alias("c")).select("c.date", F.explode("c.titles").alias("title"))


def with_ids(titles: DataFrame, live: DataFrame, known: DataFrame) -> DataFrame:
    """(date, title) with the id from today's listing, else from the table of known ids, else ''."""
    a = live.select("date", "title", F.col("id").alias("live_id"))
    b = known.filter("valid").groupBy("date", F.col("name").alias("title")).agg(F.max("sid").cast("string").alias("known_id"))
    return titles.join(a, ["date", "title"], "left").join(b, ["date", "title"], "left").select("date", "title", F.coalesce("live_id", "known_id", F.lit("")).alias("id"))


def factions(html: Column) -> Column:
    """array<struct<ord, code, name>> of the roster's pages, first of each code."""
    page = r"^([0-9]+)kaiha\.htm$"
    rows = F.transform(F.filter(tx.links(html), lambda x: x.href.rlike(page)), lambda x: F.struct(F.regexp_extract(x.href, page, 1).alias("code"), tx.plain(x.label).alias("name")))
    return F.transform(tx.first_of_each(rows, lambda x: x.code), lambda x, i: F.struct(i.alias("ord"), x.code.alias("code"), x["name"].alias("name")))


def member_name(raw: Column) -> tuple[Column, Column]:
    """(without spaces, with spaces) of a name, honorific and outer spaces off."""
    kept = F.regexp_replace(raw, r"^[\s　]+|[\s　]*君*[\s　]*$", "")
    return F.regexp_replace(kept, r"[\s　]+", ""), kept


def members(html: Column) -> Column:
    """array<struct<name, name_with_spaces, furigana, district>> of a roster page. The columns are
    those under their heads, or, on a page without heads, those of the usual classes."""

    def cell(e: Column) -> Column:
        column = F.regexp_extract(tx.attribute(e.attrs, "class"), f"(?i)^{ROSTER_CLASS}([0-9]+)$", 1)
        return F.struct(column.alias("column"), F.regexp_replace(F.regexp_replace(e.body, r"<[^>]*>", ""), r"^\s+|\s+$", "").alias("text"))

    def table(cells: Column) -> Column:
        def under(head: str, usual: str) -> Column:
            at = F.coalesce(F.try_element_at(F.filter(cells, lambda c: c.text == head), F.lit(1)).column, F.lit(usual))
            return F.filter(cells, lambda c: (c.column == at) & (c.text != head))

        names, readings, places = (under(*ROSTER_HEADS[k]) for k in ("name", "furigana", "district"))
        n = F.least(F.size(names), F.size(readings), F.size(places))
        return F.slice(F.arrays_zip(names.alias("n"), readings.alias("f"), places.alias("d")), F.lit(1), n)

    cells = F.filter(F.transform(tx.elements(html, "td"), cell), lambda c: (c.column != "") & (c.text != ""))
    rows = F.transform(tx.once(cells, table), lambda x: F.struct(member_name(x["n"].text)[0].alias("name"), member_name(x["n"].text)[1].alias("name_with_spaces"), F.btrim(F.regexp_replace(x["f"].text, r"\s+", " ")).alias("furigana"), F.btrim(x["d"].text).alias("district")))
    return F.filter(rows, lambda x: x["name"] != "")


def upper_detail(html: Column, script: Column, address: Column, described: Column | None = None) -> Column:
    """struct(m3u8, is_live, caption_url, player_url, date, title, speakers, page_url) of an upper-house
    page and its player's script; for a live one `described` is the JSON found at `text.channel_url`.
    Speakers are those of the list under its heading; other links to places of the page are none."""
    recorded = tx.stream_url(script)
    live = tx.live_url(tx.channel_url(script), F.lit(None).cast("string") if described is None else described)
    speakers = F.transform(tx.listed_speakers(html), lambda s: F.struct(s.start.alias("start"), s["name"].alias("name"), s["group"].alias("group")))
    return F.struct(F.coalesce(recorded, live).alias("m3u8"), (recorded.isNull() & live.isNotNull()).alias("is_live"), tx.caption_url(script).alias("caption_url"), tx.player_url(html).alias("player_url"), F.coalesce(tx.labelled_value(html, DATE_LABEL), F.lit("")).alias("date"), F.coalesce(tx.labelled_value(html, TITLE_LABEL), F.lit("")).alias("title"), speakers.alias("speakers"), address.alias("page_url"))


def lower_detail(html: Column, target: Column) -> Column:
    """struct(deli_id, m3u8, date, title, speakers, agenda) of a lower-house page."""
    speakers = F.transform(tx.speaker_links(html, tx.LOWER_SPEAKER, True), lambda s: F.struct(s.start.alias("start"), s["name"].alias("name"), s["group"].alias("group")))
    return F.struct(tx.deli_id(target).alias("deli_id"), tx.hidden_stream_url(html).alias("m3u8"), tx.first_date(html).alias("date"), tx.meeting_name(html).alias("title"), speakers.alias("speakers"), tx.agenda_items(html).alias("agenda"))


def unfenced(raw: Column) -> Column:
    """A response without its code fence."""
    t = F.btrim(raw, F.lit(" \t\r\n"))
    return F.when(t.rlike(r"(?s)^```(?:json)?.*```$"), F.regexp_extract(t, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)).otherwise(t)


def corrections(raw: Column) -> Column:
    """array<struct<id, text>> of a response: an object with `corrections` or a bare array;
    anything malformed is left out."""
    t = unfenced(raw)
    kind = "array<struct<id: int, text: string>>"
    found = F.coalesce(F.from_json(t, f"struct<corrections: {kind}>").corrections, F.when(t.startswith("["), F.from_json(t, kind)), F.array().cast(kind))
    return F.filter(found, lambda x: x.id.isNotNull() & x.text.isNotNull())


def terms(raw: Column, most: int = 10) -> Column:
    """Up to `most` terms of a response: an object with `terms` or a bare array of strings."""
    t = unfenced(raw)
    kind = "array<string>"
    found = F.coalesce(F.from_json(t, f"struct<terms: {kind}>").terms, F.when(t.startswith("["), F.from_json(t, kind)), F.array().cast(kind))
    return F.slice(F.filter(found, lambda x: F.coalesce(x, F.lit("")) != ""), 1, most)
