"""Text functions as Column expressions: tokens, dates, formats, cleaning and page extraction.

All work on whole strings inside the JVM; nulls give nulls unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- tokens and dates -------------------------------------------------------------------


#: A run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def lowered(text: Column) -> Column:
    """Lower-cased text; null as ''."""
    return F.lower(F.coalesce(text, F.lit("")))


def regex_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def word_break_tokens(text: Column, language: str = "ja", country: str = "JP", stop: tuple[str, ...] = ()) -> Column:
    """Tokens by the JVM's break rules for a language, for scripts without spaces: single
    characters other than ideographs and words in `stop` are left out."""
    flat = F.flatten(F.sentences(F.lower(F.coalesce(text, F.lit(""))), F.lit(language), F.lit(country)))
    kept = F.filter(flat, lambda t: (F.length(t) > 1) | t.rlike(r"^\p{IsHan}$"))
    return F.filter(kept, lambda t: ~t.isin(*stop)) if stop else kept


def normal_date(text: Column) -> Column:
    """`Y年M月D日` as a padded ISO date, anything else trimmed; null as ''."""
    plain = F.coalesce(F.btrim(text), F.lit(""))
    part = lambda i: F.regexp_extract(plain, r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise(plain)


def any_date(text: Column) -> Column:
    """A date in one of four spellings, month and day padded or not; null if none fits."""
    t = F.btrim(text)
    tries = [F.try_to_timestamp(t, F.lit(p)).cast("date") for p in ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd")]
    local = F.regexp_extract(t, r"^([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", 1)
    return F.coalesce(*tries, F.try_to_timestamp(F.nullif(local, F.lit("")), F.lit("yyyy'年'M'月'd'日'")).cast("date"))


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS, rounded down."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), two(F.floor(s / 60) % 60), two(s % 60))


def micros(moment: Column) -> Column:
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros(moment.cast("timestamp"))


def ellipsis(text: Column, most: int = 140) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def jump_url(house: Column, page: Column, start: Column) -> Column:
    """Link to a moment of a recording: a query parameter for the lower house, else a fragment."""
    at = F.floor(start).cast("long").cast("string")
    joiner = F.when(page.contains("?"), "&").otherwise("?")
    return F.when(F.coalesce(page, F.lit("")) == "", "").when(house == LOWER_HOUSE, F.concat(page, joiner, F.lit("time="), at)).otherwise(F.concat(page, F.lit("#"), at))


def percent_encoded(text: Column) -> Column:
    """RFC 3986 encoding that leaves '/' and '~' and encodes '*' and spaces as %20."""
    out = F.url_encode(text)
    for found, made in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(made))
    return out


def record_url(title: Column, search: str) -> Column:
    """Address of a search for a meeting in the official record; `search` ends before the words. ''
    without a title."""
    return F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat(F.lit(search), percent_encoded(title)))


def days_since(date_text: Column, as_of: Column) -> Column:
    """Days from the date that a text begins with, `Y-M-D` or `Y年M月D`, whatever follows; null if it
    begins with none, or with one that no calendar has."""
    part = lambda i: F.regexp_extract(date_text, r"^([0-9]{4})[-年]([0-9]{1,2})[-月]([0-9]{1,2})", i)
    return F.date_diff(as_of, F.try_to_timestamp(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("--")), F.lit("yyyy-M-d")).cast("date"))


def safe_name(text: Column, most: int = 80) -> Column:
    kept = F.regexp_replace(F.regexp_replace(text, r"[\s　]+", "_"), r'[\\/:*?"<>|]', "")
    return F.substring(kept, 1, most)


# Codes of the two houses, and the id from which numbers belong to the lower one.
UPPER_HOUSE = "sangiin"
LOWER_HOUSE = "shugiin"
FIRST_LOWER_ID = 30000


def house_of(target: Column) -> Column:
    """The house of an id or address; null where it can't be told."""
    t = F.btrim(target)
    number = F.when(t.rlike("^[0-9]+$"), t.try_cast("long"))
    by_number = F.when(number >= FIRST_LOWER_ID, LOWER_HOUSE).when(number.isNotNull(), UPPER_HOUSE)
    return F.when(t.contains(LOWER_HOUSE), LOWER_HOUSE).when(t.contains(UPPER_HOUSE), UPPER_HOUSE).otherwise(by_number)


# ---- cleaning ---------------------------------------------------------------------------

# What stands for unintelligible speech, phrases that recognisers invent over
# silence, and the characters trimmed around them.
UNCLEAR = "[音声不明瞭]"
INVENTED_PHRASES = (
    "ご視聴ありがとうございました", "ご視聴ありがとうございます", "ご清聴ありがとうございました", "視聴ありがとうございました", "字幕視聴ありがとうございました",
    "チャンネル登録お願いします", "チャンネル登録よろしくお願いします", "高評価よろしくお願いします", "Thank you for watching", "Thanks for watching",
)
TRIMMED = "。、 \t\n　"
# Ends of sentences, ends that get a full stop before a new sentence, openers of a
# sentence, and openers that get a comma.
SENTENCE_ENDS = (
    "ます", "です", "ました", "でした", "あります", "おります", "ております", "います", "ていました", "いたします", "致します", "思います", "考えます", "存じます",
    "ございます", "である", "であります", "だ", "ましょう", "でしょう", "でしょうか", "ますか", "ですか", "とのこと", "と聞いて", "と思って", "お願いいたします",
)
STRONG_ENDS = (
    "であります", "でございます", "いたします", "致します", "ました", "でした", "おります", "ております", "思います", "考えます", "存じます",
    "いたしました", "してまいります", "お願いいたします", "お願いします",
)
OPENERS = ("また", "さらに", "ただし", "なお", "しかし", "続いて", "次に", "以上", "以下", "ところで", "そこで")
NUMBERED = "第[一二三四五六七八九十]+"
MORE_OPENERS = ("その上で", "したがって", "よって")
IDEOGRAPH = "[一-龥ァ-ヶー]"


def unique_ratio(text: Column) -> Column:
    """Distinct characters over all characters; null for empty text."""
    return F.size(F.array_distinct(F.split(text, ""))) / F.when(F.length(text) > 0, F.length(text))


def is_loop(text: Column, least: int = 200, ratio: float = 0.05) -> Column:
    """A long text of hardly any distinct characters."""
    return F.coalesce((F.length(text) > least) & (unique_ratio(text) < ratio), F.lit(False))


#: A short unit ten times or more in a row.
LOOP = r"(.{1,4}?)\1{9,}"


def without_loops(text: Column) -> Column:
    """Whole-text loops replaced, else each short unit repeated ten times or more in a row."""
    return F.when(is_loop(text), UNCLEAR).otherwise(F.regexp_replace(text, LOOP, UNCLEAR))


def loops_out(text: Column) -> Column:
    """struct(text, loops, original): `without_loops`, how many loops it replaced, and the text as it
    was, null where nothing was."""
    loops = F.when(is_loop(text), 1).otherwise(F.regexp_count(text, F.lit(LOOP)))
    return F.struct(without_loops(text).alias("text"), F.coalesce(loops, F.lit(0)).alias("loops"), F.when(loops > 0, text).alias("original"))


def is_invented(text: Column) -> Column:
    """Nothing but an invented phrase, or one short phrase three times or more."""
    edge = "[" + TRIMMED.replace("\t", r"\t").replace("\n", r"\n") + r"\s]+"
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{edge}", ""), f"{edge}$", "")
    t = trim(F.coalesce(text, F.lit("")))
    alone = reduce(lambda a, p: a | (t.contains(p) & (trim(F.replace(t, F.lit(p), F.lit(""))) == "")), INVENTED_PHRASES, F.lit(False))
    return (t != "") & (t.isin(*INVENTED_PHRASES) | t.rlike(r"^(?:(.{2,40}?)\1{2,})$") | alone)


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements one after the other, longest key first, ties in order given."""
    ordered = sorted(pairs.items(), key=lambda kv: -len(kv[0]))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ordered, text)


def ends_sentence(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]+", "").rlike("(?:" + "|".join(SENTENCE_ENDS) + ")[。！？]?$")


def punctuated(text: Column) -> Column:
    """Spaces out, full stops after strong ends, commas after openers, a full stop at the end."""
    t = F.regexp_replace(text, "[ \\t]+", "")
    starts = "|".join([IDEOGRAPH, *OPENERS, NUMBERED + "に", NUMBERED + "条", "ほか[、。]?" + IDEOGRAPH])
    t = F.regexp_replace(t, "(" + "|".join(STRONG_ENDS) + f")(?={starts})", "$1。")
    openers = "|".join([*OPENERS, NUMBERED + "に", *MORE_OPENERS])
    t = F.regexp_replace(t, f"(^|。)({openers})(?={IDEOGRAPH})", "$1$2、")
    return F.when((t != "") & ~t.rlike("[。！？]$"), F.concat(t, F.lit("。"))).otherwise(t)


# ---- roles ------------------------------------------------------------------------------

# Parts of role names by class, first class that fits.
ROLE_CLASSES = (
    ("chair", ("委員長", "副委員長", "議長", "副議長", "理事")),
    ("bureaucrat", ("参考人", "統括監", "統括官", "審議官", "参事官", "局長", "次長", "長官", "室長", "官房長", "事務局", "事務総長", "幕僚長", "検事", "最高裁")),
    ("minister", ("大臣", "副大臣", "政務官", "総理", "首相")),
)
RETURN = "_return"


def role_class(role: Column, classes=ROLE_CLASSES, returning: str = RETURN, default: str = "other") -> Column:
    out = F.when(role == returning, "questioner")
    for name, parts in classes:
        out = out.when(reduce(lambda a, p: a | role.contains(p), parts, F.lit(False)), name)
    return out.otherwise(default)


# ---- pages ------------------------------------------------------------------------------


def once(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f).getItem(0)


def first_of_each(rows: Column, key) -> Column:
    """The elements of an array whose `key` no earlier element has."""
    both = F.struct(rows.alias("rows"), F.transform(rows, key).alias("keys"))
    return once(both, lambda b: F.filter(b.rows, lambda x, i: F.array_position(b["keys"], key(x)) == i + 1))


def elements(html: Column, tag: str) -> Column:
    """array<struct<attrs, body>> of the elements `tag` that hold no element of their kind."""
    form = F.lit(rf"(?is)<{tag}\b([^>]*)>(.*?)</{tag}\s*>")
    return F.arrays_zip(F.regexp_extract_all(html, form, F.lit(1)).alias("attrs"), F.regexp_extract_all(html, form, F.lit(2)).alias("body"))


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute, with either quotes or none; '' if there is none."""
    part = lambda i: F.regexp_extract(attrs, rf"""(?i)(?<![\w\-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i)
    return F.concat(part(1), part(2), part(3))


def plain(body: Column) -> Column:
    """Text of markup: tags out, white space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", ""), r"[\s　]+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element `tag`, white space collapsed; '' if there is none."""
    return F.btrim(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))


def links(html: Column) -> Column:
    """array<struct<href, label>> of all links; labels are markup."""
    found = F.filter(elements(html, "a"), lambda e: e.attrs.rlike(r"(?i)(?<![\w\-])href\s*="))
    return F.transform(found, lambda e: F.struct(attribute(e.attrs, "href").alias("href"), e.body.alias("label")))


def html_escaped(text: Column) -> Column:
    """Text as it may stand between tags and in quoted attributes."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def labelled_value(html: Column, label: str) -> Column:
    """The <dd> after the <dt> of this label; null if there is none."""
    rows = F.transform(F.split(html, r"(?i)<dt\b"), lambda part: F.struct(plain(F.regexp_extract(part, r"(?is)^[^>]*>(.*?)</dt\s*>", 1)).alias("dt"), F.regexp_extract(part, r"(?is)<dd\b[^>]*>(.*?)</dd\s*>", 1).alias("dd")))
    found = F.try_element_at(F.filter(rows, lambda r: (r.dt == label) & (F.btrim(r.dd) != "")), F.lit(1))
    return F.btrim(found.dd)


def stream_url(html: Column) -> Column:
    """Address of a recording's playlist in a player's script; null if there is none."""
    return F.nullif(F.regexp_extract(html, r'url:"([^"]+\.m3u8[^"]*)"', 1), F.lit(""))


# Keys under which a player's script names its addresses; where the player itself
# comes from; heading of the list of speakers on a page of the upper house.
CAPTION_KEY = "captionUrl"
PLAYER_SITE = "public.mediasp.jp/v1/player?"
SPEAKER_HEADING = "発言者一覧"


def caption_url(script: Column) -> Column:
    """Address of the captions in a player's script; '' if it names none."""
    return F.regexp_extract(script, rf'(?<![\w$]){CAPTION_KEY}\s*:\s*"([^"]*)"', 1)


def player_url(html: Column) -> Column:
    """Address of the first script of a page that comes from the player's site; null without one."""
    sources = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script\b([^>]*)>"), F.lit(1)), lambda a: attribute(a, "src"))
    return F.try_element_at(F.filter(sources, lambda u: F.regexp_replace(u, "^https?://", "").startswith(PLAYER_SITE) & u.rlike("^https?://") & (F.length(F.substring_index(u, "?", -1)) > 0)), F.lit(1))


def list_under(html: Column, heading: str) -> Column:
    """Markup of the list right behind the heading (h3) of this text; '' without one."""
    behind = F.transform(F.split(html, r"(?i)<h3\b"), lambda p: F.struct(plain(F.regexp_extract(p, r"(?is)^[^>]*>(.*?)</h3\s*>", 1)).alias("head"), F.regexp_extract(p, r"(?is)</h3\s*>\s*<ul\b[^>]*>(.*?)</ul\s*>", 1).alias("list")))
    found = F.filter(behind, lambda x: (x["head"] == heading) & (x["list"] != ""))
    return F.coalesce(F.try_element_at(found, F.lit(1))["list"], F.lit(""))


def channel_url(script: Column) -> Column:
    """Where a player's script says a live channel is described; null if it doesn't."""
    return F.nullif(F.regexp_extract(F.regexp_extract(script, r"channel_info:\{([^}]*)", 1), r'url:"([^"]+)"', 1), F.lit(""))


def live_url(channel: Column, described: Column) -> Column:
    """Playlist of a live channel from the description (JSON) found at `channel`."""
    return joined_url(channel, F.coalesce(F.get_json_object(described, "$.manifest"), F.lit("index.m3u8")))


def hidden_stream_url(html: Column) -> Column:
    """Address of a recording's playlist in the page's hidden field, over https; null if there is none."""
    field = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<input\b([^>]*)>"), F.lit(1)), lambda x: attribute(x, "id") == STREAM_FIELD)
    value = attribute(F.try_element_at(field, F.lit(1)), "value")
    return F.when(value.rlike(r"^http.+\.m3u8$"), secure_url(value))


def secure_url(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def joined_url(base: Column, ref: Column) -> Column:
    """An address as it stands on a page of address `base` (RFC 3986, for http and https)."""
    scheme, site = F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*):", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(F.substring(base, F.length(site) + 1, F.length(base)), r"^([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(ref, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(whole, "/")
    kept = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step), "/")
    kept = F.when(whole.rlike(r"/\.\.?$"), F.concat(kept, F.lit("/"))).otherwise(kept)
    here = F.concat(site, path, F.when(tail.startswith("?"), tail).otherwise(F.concat(query, tail)))
    return F.when(ref.rlike(r"^[a-zA-Z][\w+.\-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref)).when(own == "", here).otherwise(F.concat(site, kept, tail))


def deli_id(target: Column) -> Column:
    """Number of a recording, given as such or in an address; null where there is none."""
    t = F.btrim(target)
    return F.when(t.rlike("^[0-9]+$"), t).otherwise(F.nullif(F.regexp_extract(t, "deli_id=([0-9]+)", 1), F.lit("")))


def first_date(html: Column) -> Column:
    found = F.regexp_extract(html, r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", 1)
    return normal_date(found)


# Endings of meetings' names; the field that holds a recording's address; size and
# colour of agenda cells; label of the button that plays a recording from the start.
MEETINGS = ("委員会", "本会議", "審査会", "調査会", "公聴会")
STREAM_FIELD = "vtag_src_base_vod"
AGENDA_WIDTH, AGENDA_COLOUR = "595", "#CCCCFF"
REPLAY = "はじめから再生"
OPEN, CLOSE = "[(（]", "[)）]"


def meeting_name(html: Column) -> Column:
    """Name of the meeting from the first cell that says `name (number...`; '' if none does."""
    cells = F.transform(elements(html, "td"), lambda e: F.split(plain(e.body), OPEN, 2))
    named = F.filter(cells, lambda c: F.btrim(c[0]).rlike("(?:" + "|".join(MEETINGS) + ")$") & F.coalesce(F.try_element_at(c, F.lit(2)), F.lit("")).rlike("^[0-9]"))
    return F.coalesce(F.btrim(F.try_element_at(named, F.lit(1))[0]), F.lit(""))


def _split_label(label: Column) -> tuple[Column, Column]:
    """(name, group) of `name (group)`; the group is '' where there is none."""
    parts = F.split(label, OPEN, 2)
    rest = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    has = (F.btrim(parts[0]) != "") & rest.rlike(f".{CLOSE}\\s*$")
    return F.when(has, F.btrim(parts[0])).otherwise(label), F.when(has, F.btrim(F.regexp_replace(rest, f"{CLOSE}\\s*$", ""))).otherwise("")


#: Where a link says when a speech starts: a parameter of the lower house, a fragment of the upper.
LOWER_SPEAKER = "time=([0-9.]+)$"
UPPER_SPEAKER = """href=["']#([0-9.]+)$"""


def speaker_links(html: Column, start: str, unique: bool) -> Column:
    """array<struct<start, ord, name, group>> by start of the links whose address says when (group 1
    of `start`); `unique` keeps the first of equal (start to a tenth, name)."""
    # A link's own tag may stand outside of a fragment: all before its label counts as its address.
    parts = F.transform(F.filter(F.split(html, r"(?i)</a\s*>"), lambda p: p.contains(">")), lambda p: F.struct(F.regexp_replace(F.substring_index(F.substring_index(p, ">", -2), ">", 1), r"""["'](?:\s[^>]*)?$""", "").alias("tag"), F.substring_index(p, ">", -1).alias("label")))
    rows = F.transform(F.filter(parts, lambda x: x.tag.rlike(start)), lambda x, i: F.struct(F.regexp_extract(x.tag, start, 1).try_cast("double").alias("start"), i.alias("ord"), plain(x.label).alias("label")))
    rows = F.filter(rows, lambda x: ~x.label.isin("", REPLAY) if unique else x.label != "")
    named = F.transform(rows, lambda x: F.struct(x.start, x.ord, _split_label(x.label)[0].alias("name"), _split_label(x.label)[1].alias("group")))
    return F.array_sort(first_of_each(named, lambda x: F.struct(F.round(x.start, 1), x["name"])) if unique else named)


def listed_speakers(html: Column) -> Column:
    """array<struct<start, ord, name, group>> by start of the links to `#seconds` in the list under
    the page's heading for speakers; none without such a list."""
    seconds = lambda x: F.regexp_extract(x.href, "^#([0-9.]+)$", 1).try_cast("double")
    rows = F.transform(F.filter(links(list_under(html, SPEAKER_HEADING)), lambda x: seconds(x).isNotNull() & (plain(x.label) != "")), lambda x, i: F.struct(seconds(x).alias("start"), i.alias("ord"), plain(x.label).alias("label")))
    return F.array_sort(F.transform(rows, lambda x: F.struct(x.start, x.ord, _split_label(x.label)[0].alias("name"), _split_label(x.label)[1].alias("group"))))


def agenda_items(html: Column) -> Column:
    cells = F.filter(elements(html, "td"), lambda e: (attribute(e.attrs, "width") == AGENDA_WIDTH) & (F.upper(attribute(e.attrs, "bgcolor")) == AGENDA_COLOUR))
    return F.filter(F.transform(cells, lambda e: plain(e.body)), lambda c: c != "")


# What is no name among runs of ideographs.
NOT_NOUNS = ("に関する", "等の", "に基づく", "ことによる", "について", "に対する", "の一部", "を一部")


def proper_nouns(items: Column) -> Column:
    """Distinct runs of three or more ideographs or katakana in an array of strings, in order;
    remarks in brackets that hold a number are not looked at."""
    inside = "[^（()）]*"
    kept = F.transform(items, lambda s: F.regexp_replace(s, f"{OPEN}(?={inside}[0-9]){inside}{CLOSE}", ""))
    runs = F.flatten(F.transform(kept, lambda s: F.regexp_extract_all(s, F.lit(IDEOGRAPH + "{3,}"), F.lit(0))))
    return F.filter(F.array_distinct(runs), lambda s: ~s.isin(*NOT_NOUNS))
