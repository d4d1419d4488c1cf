"""Rows as JSON, JSON lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloquy.functions.text import clock, days_since, ellipsis, jump_url

#: Days after which the official record is likely to be out.
RECORD_DAYS = 35


def hits(found: DataFrame, as_of) -> DataFrame:
    """Search results with score to four places, link and age in days."""
    return found.select(
        F.round("score", 4).alias("score"), "house", "id", "date", "title", "speaker_name", "speaker_group", "start", "text",
        jump_url(F.col("house"), F.col("page_url"), F.col("start")).alias("jump_url"), days_since(F.col("date"), as_of).alias("days_since_meeting"), "meta_path",
    )


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, nulls written out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def hit_lines(rows: DataFrame, most_text: int = 140) -> DataFrame:
    note = F.when(F.col("days_since_meeting") > RECORD_DAYS, " *").otherwise("")
    return rows.select(F.concat_ws("  ", F.format_string("%.4f", "score"), "date", "title", F.coalesce("speaker_name", F.lit("-")), clock(F.col("start")), ellipsis(F.col("text"), most_text), F.concat("jump_url", note)).alias("value"))


def listing_lines(items: DataFrame) -> DataFrame:
    """Listing by (date, house, id) with `new_date` true where a date begins: at its first row,
    found by the least (house, id) of each date and a count among rows that share it. Null dates
    stand first and begin none."""
    first = items.groupBy("date").agg(F.min(F.struct("house", "id")).alias("__first"))
    place = F.row_number().over(Window.partitionBy("date", "house", "id").orderBy(F.lit(0)))
    begins = (F.struct("house", "id").eqNullSafe(F.col("__first"))) & (place == 1)
    return items.join(first, "date", "left").withColumn("new_date", F.coalesce(begins & F.col("date").isNotNull(), F.lit(False))).drop("__first").orderBy("date", "house", "id")


#: Weekdays from Monday, labels of the houses and of what has been fetched.
WEEKDAYS = "月火水木金土日"
HOUSE_LABELS = {"sangiin": "参議院", "shugiin": "衆議院"}
FETCHED = " ✓ 取込済"


def listing_text(items: DataFrame, command: str = "fetch") -> DataFrame:
    """(date, house, id, line, value): a listing to read, in that order. A summary stands first (its
    date is null); where a date begins there is a line with its weekday (`?` for what is no date);
    then for each item its house, title, duration and whether it has been fetched, its id with the
    command that fetches it, and its address."""
    some = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    dated = listing_lines(items.withColumns({c: some(c) for c in ("date", "house", "id")}))
    day = F.try_to_timestamp("date", F.lit("yyyy-M-d"))
    weekday = F.coalesce(F.substring(F.lit(WEEKDAYS), F.weekday(day) + 1, F.lit(1)), F.lit("?"))
    head = F.when(F.col("new_date"), F.concat(F.lit("── "), "date", F.lit(" ("), weekday, F.lit(") ──")))
    house = F.when(F.col("house") == "sangiin", HOUSE_LABELS["sangiin"]).otherwise(HOUSE_LABELS["shugiin"])
    title = F.concat(F.lit("  ["), house, F.lit("] "), some("title"), F.when(some("duration") != "", F.concat(F.lit(" / "), "duration")).otherwise(""), F.when(F.coalesce("fetched", F.lit(False)), FETCHED).otherwise(""))
    known = F.when(F.col("id") != "", F.concat(F.lit("    id="), "id", F.lit(f"  {command} "), "id")).otherwise("    id=?")
    lines = F.filter(F.array(head, title, known, F.concat(F.lit("    "), some("page_url"))), lambda x: x.isNotNull())
    each = dated.select("date", "house", "id", F.posexplode(lines).alias("line", "value"))
    total = items.agg(F.count("*").alias("n")).select(*[F.lit(None).cast("string").alias(c) for c in ("date", "house", "id")], F.lit(0).alias("line"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" 件]")).alias("value"))
    return total.unionByName(each).orderBy(F.asc_nulls_first("date"), "house", "id", "line")


def listing_json_lines(items: DataFrame) -> DataFrame:
    """(type, value): one JSON line with the number of items, and one for each item."""
    each = items.withColumn("type", F.lit("item")).select("type", F.to_json(F.struct(*items.columns, F.lit("item").alias("type")), {"ignoreNullFields": "false"}).alias("value"))
    total = items.agg(F.count("*").alias("n_items")).select(F.lit("summary").alias("type"), F.to_json(F.struct(F.lit("summary").alias("type"), "n_items")).alias("value"))
    return total.unionByName(each)


def compact_meta(rows: DataFrame) -> DataFrame:
    """What other tools need of a meeting, one JSON object a row; what is empty is left out."""
    some = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).alias(name)
    full = lambda name, column: F.when(F.size(name) > 0, column).alias(name)
    speakers = F.transform("speakers", lambda s: F.struct(s.start.alias("start"), s["name"].alias("name"), s["group"].alias("group")))
    return rows.select(F.to_json(F.struct(some("date"), some("title"), some("deli_id"), full("speakers", speakers), full("agenda", F.col("agenda")))).alias("value"))


def speaker_events(rows: DataFrame, key: str) -> DataFrame:
    """(key, i, value): one JSON line for each speaker of a meeting, in order."""
    each = rows.select(key, F.posexplode("speakers").alias("i", "s"))
    line = F.struct(F.lit("speaker").alias("type"), F.col("i"), F.col("s.start").alias("start"), F.col("s.name").alias("name"), F.col("s.group").alias("group"))
    return each.select(key, "i", F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def meta_records(rows: DataFrame, phase: str, generated_at: Column) -> DataFrame:
    """(house, id, value): the metadata file of each meeting. Meetings that are on, or have no
    speakers yet, are marked to be fetched again."""
    live = F.coalesce("is_live", F.lit(False)) | (F.coalesce(F.size("speakers"), F.lit(0)) < 1)
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    pipeline = F.struct(F.lit(phase).alias("phase"), F.when(live, F.lit(True)).alias("live")).alias("pipeline")
    record = F.struct("house", "id", text("date"), text("title"), "page_url", F.coalesce("speakers", F.array().cast(dict(rows.dtypes)["speakers"])).alias("speakers"), "files", pipeline, generated_at.alias("generated_at"))
    return rows.select("house", "id", F.to_json(record).alias("value"))


def transcript_records(rows: DataFrame) -> DataFrame:
    """(deli_id, value): the transcript of each meeting with its cues as recognised."""
    return rows.select("deli_id", F.to_json(F.struct("deli_id", "title", "date", "hint", "cues"), {"ignoreNullFields": "false"}).alias("value"))


def write_records(records: DataFrame, path: str, *by: str) -> None:
    """Write the JSON of `value` as lines, in folders by the columns `by`."""
    records.select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)


def duration_label(seconds: Column) -> Column:
    """`H時間M分`, `M分S秒` or `S秒`, seconds rounded towards zero."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    text = lambda *xs: F.concat(*[x.cast("string") if i % 2 == 0 else F.lit(x) for i, x in enumerate(xs)])
    return F.when(h > 0, text(h, "時間", m, "分")).when(m > 0, text(m, "分", s % 60, "秒")).otherwise(text(s, "秒"))
