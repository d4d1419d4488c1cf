"""Prompts for recognisers, from a meeting's metadata, and one-line summaries of a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloquy.functions.text import proper_nouns
from veloquy.operators.catalog import top_per_group

# Terms common to all meetings, in order.
COMMON_TERMS = (
    "委員長", "大臣", "副大臣", "政府参考人", "提出者", "理事", "答弁", "質疑", "質問", "趣旨説明", "採決", "可決", "付託", "聴取",
    "民法", "改正", "施行", "附則", "後見", "保佐", "補助", "成年後見", "事理弁識", "家庭裁判所",
)
# Fixed value: endings of groups that are roles, not factions.
ROLE_ENDING = "(?:委員長|議長|副議長|大臣|副大臣|政務官|政府参考人)$"


def speaker_names(speakers: Column) -> Column:
    return F.array_distinct(F.transform(speakers, lambda s: s["name"]))


def speaker_factions(speakers: Column) -> Column:
    groups = F.transform(speakers, lambda s: F.btrim(s["group"]))
    return F.array_distinct(F.filter(groups, lambda g: (g != "") & ~g.rlike(ROLE_ENDING)))


def colleagues(meetings: DataFrame, members: DataFrame, key: str, per_faction: int = 3) -> DataFrame:
    """(key, names): for each faction of a meeting, in order, its first members by roster order
    who don't speak there. `members`: name, faction, roster."""
    wanted = meetings.select(key, F.posexplode(speaker_factions(F.col("speakers"))).alias("at", "faction"), speaker_names(F.col("speakers")).alias("present"))
    joined = wanted.join(members.select("faction", "name", "roster"), "faction").filter(~F.array_contains("present", F.col("name")))
    joined = joined.withColumn("__group", F.struct(key, "at"))
    best = top_per_group(joined, "__group", per_faction, "roster")
    ordered = F.array_sort(F.collect_list(F.struct("at", "roster", "name")))
    return best.groupBy(key).agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def tiers(title: Column, date: Column, speakers: Column, agenda: Column, related: Column) -> Column:
    """Array of prompt lines, most important first, empty ones left out."""
    line = lambda label, words: F.when(F.size(words) > 0, F.concat(F.lit(label), F.array_join(words, "、"), F.lit("。")))
    head = F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("（"), F.coalesce(date, F.lit("")), F.lit("）。")), "^[（）]+|[（）]+$", "")
    common = F.lit("用語: " + "、".join(COMMON_TERMS) + "。")
    lines = F.array(head, line("発言者: ", speaker_names(speakers)), line("会派: ", speaker_factions(speakers)), line("議題: ", proper_nouns(agenda)), line("関連議員: ", related), common)
    return F.filter(lines, lambda x: x.isNotNull())


def within(lines: Column, most: int = 160) -> Column:
    """The longest prefix of `lines` with at most `most` characters, joined by line ends."""
    total = lambda i: F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
    n = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: total(i) <= most)), F.lit(0))
    return F.array_join(F.slice(lines, F.lit(1), n), "\n")


def with_terms(prompt: Column, terms: Column, most: int = 600) -> Column:
    """`prompt` with those terms that it doesn't contain yet, cut to `most` characters."""
    base = F.coalesce(prompt, F.lit(""))
    new = F.filter(terms, lambda t: ~base.contains(t))
    joined = F.concat(base, F.when(base != "", " ").otherwise(""), F.array_join(new, "、"))
    return F.when(F.size(new) > 0, F.substring(joined, 1, most)).otherwise(base)


def pending(meta: DataFrame) -> DataFrame:
    """Meetings recorded while they were on, to be fetched again."""
    return meta.filter(F.coalesce("pipeline.live", F.lit(False)) & (F.coalesce("id", F.lit("")) != ""))


def summary(p: str = "pipeline") -> Column:
    """What made a page, in one line; '' where it isn't known."""
    at = lambda name: F.col(f"{p}.{name}")
    number = lambda name: F.coalesce(at(name).cast("int"), F.lit(0))
    yes = lambda name: F.coalesce(at(name).cast("boolean"), F.lit(False))
    made = F.concat(F.lit("ASR: "), F.coalesce(at("asr_backend"), F.lit("?")), F.lit(" / "), F.coalesce(at("asr_model"), F.lit("?")))
    hint = F.when(F.coalesce(at("hint"), F.lit("")) != "", F.concat(F.lit("hint "), number("hint_chars"), F.lit("字注入"))).otherwise("hint なし")
    invented = F.when(number("preclean_hallucinations") > 0, F.concat(F.lit("幻覚 "), number("preclean_hallucinations"), F.lit(" 件")))
    loops = F.when(number("preclean_loops") > 0, F.concat(F.lit("degenerate loop "), number("preclean_loops"), F.lit(" 件")))
    cleaned = F.when(invented.isNotNull() | loops.isNotNull(), F.concat(F.lit("preclean "), F.concat_ws("・", invented, loops)))
    glossary = F.when(yes("glossary"), F.concat(F.lit("glossary "), number("glossary_changes"), F.lit(" 箇所")))
    context = F.when(yes("llm_context"), F.concat(F.lit("2-pass context ("), F.coalesce(F.size(at("llm_context_terms")), F.lit(0)), F.lit(" 語)")))
    corrected = F.when(yes("llm_correct"), F.concat(F.lit("LLM 校正 "), number("llm_correct_changes"), F.lit(" 箇所"))).otherwise("LLM 校正なし")
    asr = F.concat_ws("・", made, hint, cleaned, glossary, context, corrected)
    return F.when(at("phase") == "vtt", "公式 VTT 字幕").when(at("phase") == "phase2", "タイムラインのみ").when(at("phase") == "asr", asr).otherwise("")


def turns(sections: DataFrame, key: str, text: str, primary: str, calls: str, group: str | None = None) -> DataFrame:
    """(key, at, speaker, klass, role, text): a section cut at its speaker calls; with `group`, the
    primary speaker's, also that column: the head has it, what is called out has ''.

    `calls` is an array of struct(name, role_str, start) by start (0-based characters), from
    whatever analyser finds them; the head before the first belongs to the primary speaker, and
    so do returns to that speaker. Neighbours of one speaker and class stay apart; see `merged_turns`."""
    from veloquy.functions.text import RETURN, role_class

    kind = "array<struct<name: string, role_str: string, start: int>>"
    head = F.array(F.struct(F.col(primary).alias("name"), F.lit(RETURN).alias("role_str"), F.lit(0).alias("start")))
    own = F.coalesce(calls, F.array().cast(kind))
    every = F.when(F.coalesce(F.try_element_at(own, F.lit(1)).start, F.lit(1)) > 0, F.concat(head, own)).otherwise(own)
    headed = F.coalesce(F.try_element_at(own, F.lit(1)).start, F.lit(1)) > 0
    rows = sections.select(key, text, primary, F.col(text).alias("__text"), every.alias("__calls"), F.when(headed, F.col(group) if group else F.lit("")).otherwise("").alias("__group"))
    each = rows.select(key, primary, "__text", "__calls", "__group", F.posexplode("__calls").alias("at", "call"))
    end = F.coalesce(F.try_element_at("__calls", F.col("at") + 2).start, F.length("__text"))
    part = F.regexp_replace(F.substring("__text", F.col("call.start") + 1, end - F.col("call.start")), r"^[\s　]+|[\s　]+$", "")
    back = (F.col("call.role_str") == RETURN) | (F.col("call.name") == F.col(primary))
    out = each.select(key, "at", F.when(back, F.col(primary)).otherwise(F.col("call.name")).alias("speaker"), F.when(back, "questioner").otherwise(role_class(F.col("call.role_str"))).alias("klass"), F.when(back, "議員").otherwise(F.col("call.role_str")).alias("role"), *([F.when(F.col("at") == 0, F.coalesce("__group", F.lit(""))).otherwise("").alias("group")] if group else []), part.alias("text"))
    return out.filter("text <> ''")


def merged_turns(turned: DataFrame, key: str) -> DataFrame:
    """`turns` with neighbours of one speaker and class as one: the first one's place, role and
    group, the texts with a space between. A section is one text, so its turns fit a task."""
    by = Window.partitionBy(key).orderBy("at")
    new = ~(F.lag("speaker").over(by).eqNullSafe(F.col("speaker")) & F.lag("klass").over(by).eqNullSafe(F.col("klass"))) | (F.row_number().over(by) == 1)
    runs = turned.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min_by(c, "at").alias(c) for c in turned.columns if c not in (key, "at", "text")]
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    out = runs.groupBy(key, "__run").agg(F.min("at").alias("at"), *first, F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    return out.select(*turned.columns)


def correction_requests(cues: DataFrame, by: str, order: str, text: str, context: Column | None = None, size: int = 8) -> DataFrame:
    """(by, batch, value): JSON requests of `size` cues each; ids count from 0 in a request."""
    from veloquy.operators.catalog import batches

    each = batches(cues.select(by, order, text), by, order, size)
    found = each.groupBy(by, "batch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("t")))).alias("all"))
    listed = F.transform("all", lambda x, i: F.struct(i.alias("id"), x["t"].alias("text"))).alias("cues")
    return found.select(by, "batch", F.to_json(F.struct(listed, (F.lit(None).cast("string") if context is None else F.nullif(context, F.lit(""))).alias("context"))).alias("value"))


def smoke_report(turns: DataFrame, section: str, text: str, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of turns (section, speaker, klass, role, text): the `k` most frequent roles, the respondents
    in order, and sections of over 200 characters in which nobody answers."""
    roles = turns.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(k)
    answers = F.col("klass") != "questioner"
    respondents = turns.filter(answers).select("speaker").distinct().orderBy("speaker")
    silent = turns.groupBy(section).agg(F.sum(F.length(text)).alias("n_chars"), F.max(answers).alias("answered")).filter(~F.col("answered") & (F.col("n_chars") > 200))
    return roles, respondents, silent.select(section, "n_chars")
