"""Speaker calls in captions, by a lexicon of names and roles.

Without a morphological analyser the names come from lists: full names and surnames. A call is a
name (or several in a row) with a role, and before it the rest of a title of any length, or with a
form of address right behind it, unless a particle follows: then the person is only spoken of. A
title is up to three runs of one script each, and part of one more, without punctuation.

`speaker_calls` takes a meeting's own short list for each row and stays in the JVM; `roster_calls`
takes a whole roster, as one automaton over all its names that each task builds once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquy.functions.text import RETURN, once
from veloquy.session import small_batches

# Roles as they are called out, forms of address that hand back to the questioner,
# words that are no names, particles behind a mention with what makes them the start of a word.
CALLED_ROLES = (
    "内閣総理大臣", "総理大臣", "国務大臣", "副大臣", "大臣政務官", "政務官", "総理", "首相", "大臣",
    "議長", "副議長", "委員長", "副委員長", "理事", "政府参考人", "参考人",
    "内閣官房副長官", "内閣官房長官", "官房副長官", "官房長官", "総括審議官", "審議官", "参事官", "統括監", "統括官",
    "推進事務局長", "事務局長", "事務総長", "局長", "次長", "長官", "室長",
    "統合幕僚長", "陸上幕僚長", "海上幕僚長", "航空幕僚長", "検事総長", "最高裁長官",
)
ADDRESSES = ("くん", "君", "氏")
NO_NAMES = (
    "今", "先", "前", "次", "別", "他", "今後", "今日", "今回", "今般", "本日", "本年", "明日", "昨日",
    "東京", "日本", "国会", "参議院", "衆議院", "我が国", "我国", "我",
)
PARTICLES = ("の", "に", "が", "を", "へ", "は(?!い)", "と(?!ころ)", "も(?!ちろん|う)", "から", "より", "まで", "や(?!はり)")
PAGE_CHAIRS = ("委員長", "議長", "副議長")

_ROLES = "|".join(sorted(CALLED_ROLES, key=len, reverse=True))
#: Characters of one script; what stands in none of them (punctuation, spaces) ends a title.
_SCRIPTS = ("一-鿿㐀-䶿々〆〇ヶ", "ァ-ヵヷ-ヺー", "ぁ-ゖ", "A-Za-z0-9Ａ-Ｚａ-ｚ０-９・－-")
_RUNS = "|".join(f"[{x}]++" for x in _SCRIPTS)
_PART = "|".join(f"[{x}]*?" for x in _SCRIPTS)
#: Written so that Java and Python read it alike.
_AFTER = f"((?:(?:{_RUNS}){{0,3}}?(?:{_PART})(?:{_ROLES}))|(?:{'|'.join(ADDRESSES)}))(?!{'|'.join(PARTICLES)})"
#: Names of a roster at most; each task holds all of them.
MOST_NAMES = 200_000
MOST_BYTES = 40_000
KIND = "array<struct<name: string, role_str: string, start: int>>"


def ends_in_role(text: Column) -> Column:
    """Whether a text without punctuation ends in a role."""
    return ~text.rlike("[、。,. ]") & text.rlike(f"(?:{_ROLES})$")


def speaker_calls(text: Column, names: Column) -> Column:
    """array<struct<name, role_str, start>> of the calls in a text, by start (0-based characters);
    none without names or text."""
    usable = F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "") & ~n.isin(*NO_NAMES)))
    longest_first = F.array_sort(F.transform(usable, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    listed = F.array_join(F.transform(longest_first, lambda x: F.concat(F.lit(r"\Q"), x.n, F.lit(r"\E"))), "|")
    none = F.array().cast(KIND)

    def found(form: Column) -> Column:
        part = lambda i: F.regexp_extract_all(text, form, F.lit(i))
        # What stands before each call tells where it is.
        between = F.slice(F.split(text, form, -1), F.lit(1), F.size(part(0)))
        calls = F.arrays_zip(between.alias("before"), part(0).alias("all"), part(1).alias("name"), part(2).alias("role"))

        def step(s: Column, c: Column) -> Column:
            at = s["after"] + F.length(c.before)
            role = F.when(c.role.isin(*ADDRESSES), RETURN).otherwise(c.role)
            one = F.struct(c["name"].alias("name"), role.alias("role_str"), at.alias("start"))
            return F.struct(F.concat(s["calls"], F.array(one)).alias("calls"), (at + F.length(c["all"])).alias("after"))

        return F.aggregate(calls, F.struct(none.alias("calls"), F.lit(0).alias("after")), step, lambda s: s["calls"])

    form = F.concat(F.lit("((?:"), listed, F.lit(")+)" + _AFTER))
    return F.when(text.isNull() | (F.coalesce(F.size(usable), F.lit(0)) < 1), none).otherwise(once(form, found))


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(start, piece): a text cut behind the last end of a sentence before MOST_BYTES are full, or
    there if no sentence ends."""
    start = 0
    while len(rest := text[start:].encode()) > MOST_BYTES:
        head = rest[:MOST_BYTES].decode(errors="ignore")
        stop = max(head.rfind(c) for c in "。！？\n") + 1 or len(head)
        yield start, head[:stop]
        start += stop
    yield start, text[start:]


_BEHIND = re.compile(_AFTER)


def calls_in(text: str, automaton) -> list[tuple[str, str, int]]:
    """(name, role_str, start) of the calls in a text; `automaton` has the names of a roster."""
    found = []
    for offset, piece in _pieces(text):
        names: list[list[int]] = []  # [start, end] of names, those in a row joined
        for last, length in automaton.iter_long(piece):
            if names and names[-1][1] == last - length + 1:
                names[-1][1] = last + 1
            else:
                names.append([last - length + 1, last + 1])
        after = 0
        for start, end in names:
            if start < after or piece[start:end] in NO_NAMES:
                continue
            hit = _BEHIND.match(piece, end)
            if hit:
                found.append((piece[start:end], RETURN if hit[1] in ADDRESSES else hit[1], offset + start))
                after = hit.end()
    return found


def roster_calls(rows: DataFrame, text_col: str, roster: DataFrame, name_col: str = "name", out: str = "calls") -> DataFrame:
    """`rows` with the calls in `text_col` by the names of a roster (as `speaker_calls`), whoever the
    meeting's list has. The roster is one row for each person, MOST_NAMES at most; no shuffle."""
    listed = roster.select(name_col).filter(F.coalesce(F.col(name_col), F.lit("")) != "").distinct().limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError("the roster has more names than a task can hold")
    names = [r[0] for r in listed]

    @F.pandas_udf(KIND)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in names:
            automaton.add_word(n, len(n))
        automaton.make_automaton()
        for texts in parts:
            yield pd.Series([[{"name": n, "role_str": r, "start": s} for n, r, s in calls_in(t, automaton)] if t and names else [] for t in texts])

    # Taken for deterministic, the optimizer would write it into each use of the calls (a filter for
    # those that have any, too), and each would run with Python workers of its own.
    return small_batches(rows).withColumn(out, run.asNondeterministic()(F.col(text_col)))


def page_class(group: Column) -> Column:
    """`chair` for a group that chairs, else `questioner`."""
    return F.when(F.coalesce(group, F.lit("")).rlike("|".join(PAGE_CHAIRS)), "chair").otherwise("questioner")


def chunk_starts(text: Column, most_bytes: int = 40_000) -> Column:
    """array<struct<start, text>>: a text in pieces of at most `most_bytes` UTF-8 bytes that end at
    。！？ or a line end where there is one, else anywhere; start counts characters."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[^。！？\n]*[。！？\n]|[^。！？\n]+"), F.lit(0)), lambda p: F.when(F.octet_length(p) <= most_bytes, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{max(1, most_bytes // 4)}}}"), F.lit(0)))))

    def step(s: Column, p: Column) -> Column:
        last = F.try_element_at(s.done, F.lit(-1))
        fits = F.octet_length(last.text) + F.octet_length(p) <= most_bytes
        longer = F.concat(F.slice(s.done, F.lit(1), F.size(s.done) - 1), F.array(F.struct(last.start.alias("start"), F.concat(last.text, p).alias("text"))))
        new = F.concat(s.done, F.array(F.struct(s.at.alias("start"), p.alias("text"))))
        return F.struct(F.when(F.coalesce(fits, F.lit(False)), longer).otherwise(new).alias("done"), (s.at + F.length(p)).alias("at"))

    start = F.struct(F.array().cast("array<struct<start: int, text: string>>").alias("done"), F.lit(0).alias("at"))
    return F.aggregate(parts, start, step, lambda s: s.done)
