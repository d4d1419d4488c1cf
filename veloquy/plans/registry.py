"""All queries of the engine over the driver's tables, and SQL that must give the same rows.

Analogues: documents stand for cues (lang for the house, source for the committee), events of
one user for a meeting's timeline (`signup` rows are its speakers), conversations for turns,
labels for what has been fetched.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloquy.functions import calls
from veloquy.functions import text as tx
from veloquy.functions.query import parse_query
from veloquy.operators import attribution as at
from veloquy.operators import catalog, postings, prompts, render, segments
from veloquy.operators import search as se
from veloquy.sources import captions, pages
from veloquy.storage import new_path, stored
from veloquy.streaming import tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- search -----------------------------------------------------------------------------


def _bm25_sql(terms: dict[str, int], where: str = "true", phrase: str = "true", k: int | None = 10) -> str:
    weights = " union all ".join(f"select '{t}' as term, {n} as times" for t, n in terms.items())
    limit = f" order by score desc, doc_id limit {k}" if k else ""
    return f"""
    with d as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as toks from documents where {where}),
    q as ({weights}),
    s as (select count(*)::double as n, avg(len(toks)) as avgdl from d),
    tf as (select d.doc_id, q.term, q.times, len(list_filter(d.toks, lambda x : x = q.term))::double as f, len(d.toks) as dl from d, q where list_contains(d.toks, q.term)),
    df as (select term, count(*)::double as df from tf group by term),
    sc as (select tf.doc_id, sum(times * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as raw
           from tf join df using (term), s group by tf.doc_id)
    select sc.doc_id, round(raw, 4) as score from sc join d using (doc_id) where {phrase}{limit}"""


def _hits(docs: DataFrame, text: str, k: int | None = 10) -> DataFrame:
    found = se.bm25(docs, parse_query(text)).select("doc_id", F.round("score", 4).alias("score"))
    return found if k is None else se.top(found, k, "doc_id")


def _as_cues(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"house": F.col("lang"), "title": F.col("source")})


@query(_bm25_sql({"clown": 1, "theration": 1, "moron": 1}))
def bm25_topk(spark, sf_dir):
    return _hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "theration clown moron")


@query(_bm25_sql({"moron": 1, "trash": 1}, "lang = 'en' and contains(coalesce(source, ''), 'src1')"))
def bm25_filtered(spark, sf_dir):
    return _hits(se.filtered(_as_cues(table(spark, sf_dir, "documents")), house="en", committee="src1").select("doc_id", "text"), "moron trash")


@query(_bm25_sql({"that": 1, "thing": 1}, phrase="contains(d.text, 'of the')"))
def bm25_phrase(spark, sf_dir):
    """The phrase filters what is scored, not what is counted."""
    return _hits(table(spark, sf_dir, "documents").select("doc_id", "text"), 'that "of the" thing')


@query("select doc_id, 0.0::double as score from documents where false")
def bm25_phrase_only(spark, sf_dir):
    return _hits(table(spark, sf_dir, "documents").select("doc_id", "text"), '"of the"')


@query(_bm25_sql({"idiot": 2, "with": 1}))
def bm25_repeated_terms(spark, sf_dir):
    return _hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "idiot with idiot")


@query(_bm25_sql({"moron": 1, "de": 1}, k=None))
def bm25_all_scores(spark, sf_dir):
    return _hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "moron de", None)


def _kept(hits: DataFrame, path: str) -> DataFrame:
    """The few best hits of an index that is then deleted."""
    spark, found = hits.sparkSession, hits.collect()
    segments.clear(spark, path)
    return spark.createDataFrame(found, hits.schema).select("doc_id", F.round("score", 4).alias("score"))


def _index(spark: SparkSession, sf_dir: str, path: str) -> tuple[DataFrame, postings.Index]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs, postings.build(docs, path, "doc_id", metadata=("lang", "source"))


@query(_bm25_sql({"clown": 1, "theration": 1, "moron": 1}))
def postings_topk(spark, sf_dir):
    path = new_path(spark, "index")
    _, index = _index(spark, sf_dir, path)
    return _kept(postings.search(index, parse_query("theration clown moron")), path)


@query(_bm25_sql({"idiot": 2, "with": 1, "that": 1}, "lang = 'en' and contains(coalesce(source, ''), 'src1')", "contains(d.text, 'of the')"))
def postings_filtered(spark, sf_dir):
    """Filters narrow what is counted, the phrase what is found."""
    path = new_path(spark, "index")
    docs, index = _index(spark, sf_dir, path)
    where = (F.col("lang") == "en") & F.coalesce("source", F.lit("")).contains("src1")
    return _kept(postings.search(index, parse_query('idiot with idiot that "of the"'), where=where, texts=docs), path)


def _segments(spark: SparkSession, sf_dir: str, path: str) -> segments.SegmentIndex:
    """Sources stand for files. A first state has other texts in src3, no src7 and a file that
    goes away; then the index follows to the table as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("path"), F.lit(2).alias("stamp"))
    other = F.col("path") == "src3"
    before = docs.filter("path is null or path <> 'src7'").withColumns({"text": F.when(other, F.upper("text")).otherwise(F.col("text")), "stamp": F.when(other, 1).otherwise(F.col("stamp"))})
    gone = docs.filter("path = 'src1'").withColumns({"doc_id": -1 - F.col("doc_id"), "path": F.lit("gone")})
    for state in (before.unionByName(gone), docs):
        index = segments.update(spark, path, state.select("path", "stamp"), lambda files, s=state: s.join(files.withColumnsRenamed({"path": "p", "stamp": "t"}), F.col("path").eqNullSafe(F.col("p")) & (F.col("stamp") == F.col("t")), "left_semi"), "doc_id", metadata=("lang", "path"))
    return index


@query(_bm25_sql({"clown": 1, "theration": 1, "moron": 1}))
def segments_topk(spark, sf_dir):
    path = new_path(spark, "segments")
    return _kept(segments.search(_segments(spark, sf_dir, path), parse_query("theration clown moron")), path)


@query(_bm25_sql({"with": 1, "that": 1, "moron": 1}))
def segments_block_maxima(spark, sf_dir):
    """After a compaction, and with the bounds of blocks looked at first."""
    path = new_path(spark, "segments")
    _segments(spark, sf_dir, path)
    return _kept(segments.search(segments.compact(spark, path), parse_query("with that moron"), direct=0), path)


@query(_bm25_sql({"idiot": 2, "with": 1, "that": 1}, "lang = 'en' and contains(coalesce(source, ''), 'src1')", "contains(d.text, 'of the')"))
def segments_filtered_phrase(spark, sf_dir):
    path = new_path(spark, "segments")
    where = (F.col("lang") == "en") & F.coalesce("path", F.lit("")).contains("src1")
    return _kept(segments.search(_segments(spark, sf_dir, path), parse_query('idiot with idiot that "of the"'), where=where), path)


@query("select term, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) group by term")
def term_df(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(tx.regex_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("select count(*) as n, round(avg(len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))), 4) as mean_length from documents")
def doc_len_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return se.statistics(docs, []).select("n", F.round("mean_length", 4).alias("mean_length"))


@query("select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) where term in ('moron', 'clown', 'the') group by doc_id, term")
def term_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(tx.regex_tokens(F.col("text"))).alias("term")).filter(F.col("term").isin("moron", "clown", "the"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


# ---- attribution ------------------------------------------------------------------------

_SPEAKERS = "sp as (select user_id, ts, event_id as speaker from events where event_type = 'signup'), cu as (select user_id, ts, event_id, event_type from events where event_type <> 'signup')"


def _timeline(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    speakers = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("speaker"))
    return events.filter("event_type <> 'signup'").select("user_id", "ts", "event_id", "event_type"), speakers


@query(f"""with {_SPEAKERS}, f as (select user_id, arg_min(speaker, ts) as first from sp group by user_id)
    select cu.event_id, cu.user_id, coalesce(sp.speaker, f.first) as speaker from cu asof left join sp on cu.user_id = sp.user_id and cu.ts >= sp.ts left join f on cu.user_id = f.user_id""")
def asof_clamped(spark, sf_dir):
    cues, speakers = _timeline(spark, sf_dir)
    return at.as_of(cues, speakers, "user_id", "ts", ["speaker"]).select("event_id", "user_id", "speaker")


@query(f"""with {_SPEAKERS}, f as (select user_id, arg_min(speaker, ts) as first from sp group by user_id)
    select cu.event_id, cu.user_id, coalesce(sp.speaker, f.first) as speaker from cu asof left join sp on cu.user_id = sp.user_id and cu.ts >= sp.ts left join f on cu.user_id = f.user_id""")
def asof_ranges(spark, sf_dir):
    """The same, with a user's events dealt over tasks by ranges of time."""
    cues, speakers = _timeline(spark, sf_dir)
    return at.as_of_ranges(cues, speakers, "user_id", "ts", ["speaker"]).select("event_id", "user_id", "speaker")


@query(f"""with {_SPEAKERS}, f as (select user_id, arg_min(speaker, ts) as first from sp group by user_id),
    a as (select coalesce(sp.speaker, f.first) as speaker from cu asof left join sp on cu.user_id = sp.user_id and cu.ts >= sp.ts left join f on cu.user_id = f.user_id)
    select sp.user_id, sp.speaker, count(a.speaker) as n_cues from sp left join a on sp.speaker = a.speaker group by all""")
def asof_keep_empty(spark, sf_dir):
    """Every speaker, also without cues; cues before the first go to the first."""
    cues, speakers = _timeline(spark, sf_dir)
    counts = at.as_of(cues, speakers, "user_id", "ts", ["speaker"]).groupBy("speaker").agg(F.count("*").alias("n"))
    return speakers.select("user_id", "speaker").join(counts, "speaker", "left").select("user_id", "speaker", F.coalesce("n", F.lit(0).cast("long")).alias("n_cues"))


@query(f"""with {_SPEAKERS}, a as (select cu.*, sp.speaker from cu asof join sp on cu.user_id = sp.user_id and cu.ts >= sp.ts)
    select sp.user_id, sp.speaker, count(a.event_id) as n_cues, coalesce(string_agg(a.event_type, ' ' order by a.ts, a.event_id), '') as event_type from sp left join a on sp.speaker = a.speaker group by all""")
def interval_drop_head(spark, sf_dir):
    cues, speakers = _timeline(spark, sf_dir)
    return at.interval_groups(cues, speakers, "user_id", "ts", "speaker", "event_type", "event_id")


@query(f"with {_SPEAKERS}, w as (select *, lead(ts) over (partition by user_id order by ts) as nxt from sp) select user_id, speaker, epoch_us(nxt) - epoch_us(ts) as micros from w")
def next_start_duration(spark, sf_dir):
    _, speakers = _timeline(spark, sf_dir)
    return at.with_next(speakers, "user_id", "ts").select("user_id", "speaker", (tx.micros(F.col("next_start")) - tx.micros(F.col("ts"))).alias("micros"))


@query(f"""with {_SPEAKERS}, f as (select user_id, min(ts) as first from sp group by user_id)
    select cu.event_id, greatest(0, epoch_us(cu.ts) - epoch_us(coalesce(sp.ts, f.first))) as micros from cu asof left join sp on cu.user_id = sp.user_id and cu.ts >= sp.ts left join f on cu.user_id = f.user_id where coalesce(sp.ts, f.first) is not null""")
def relative_time(spark, sf_dir):
    cues, speakers = _timeline(spark, sf_dir)
    owned = at.as_of(cues, speakers.withColumn("began", F.col("ts")), "user_id", "ts", ["began"]).filter("began is not null")
    return owned.select("event_id", F.greatest(F.lit(0).cast("long"), tx.micros(F.col("ts")) - tx.micros(F.col("began"))).alias("micros"))


@query("""with c as (select *, case when role is not distinct from lag(role) over (partition by conv_id order by turn) and turn > min(turn) over (partition by conv_id) then 0 else 1 end as fresh from conversations),
    r as (select *, sum(fresh) over (partition by conv_id order by turn) as run from c)
    select conv_id, run::bigint as run, role, count(*) as n, string_agg(text, ' ' order by turn) as text from r group by conv_id, run, role""")
def turn_islands(spark, sf_dir):
    return at.runs(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role"], "text")


@query("select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id")
def ordered_transcript(spark, sf_dir):
    return at.ordered_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""with f as (select conv_id, role, min(turn) as first_turn from conversations group by conv_id, role)
    select conv_id, string_agg(role, '>' order by first_turn) as roles, count(*) as n_roles from f group by conv_id""")
def distinct_speakers(spark, sf_dir):
    """Distinct roles in order of their first turn."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    first = F.array_distinct(F.transform("r", lambda x: x.role))
    return rows.select("conv_id", F.array_join(first, ">").alias("roles"), F.size(first).cast("long").alias("n_roles"))


# ---- windows, sets, joins ---------------------------------------------------------------


@query("select min(doc_id) as doc_id, text from documents group by text")
def first_occurrence_dedup(spark, sf_dir):
    return catalog.first_of(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 8 as batch from conversations")
def batch_numbers(spark, sf_dir):
    return catalog.batches(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("select conv_id, turn, so_far::bigint as so_far from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as so_far from conversations) where so_far <= 600")
def budgeted_prefix(spark, sf_dir):
    return catalog.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600).select("conv_id", "turn", "so_far")


@query("""select n_name, c_custkey, place from (select n_name, c_custkey, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) as place
    from customer join nation on c_nationkey = n_nationkey where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)) where place <= 3""")
def topk_per_group(spark, sf_dir):
    """Three of each group in a fixed order, those already named left out."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rest = people.join(named, "c_custkey", "left_anti").select("n_name", "c_custkey", "c_acctbal")
    return catalog.top_per_group(rest, "n_name", 3, F.desc("c_acctbal"), "c_custkey").select("n_name", "c_custkey", "place")


@query("select d.doc_id, l.doc_id is not null as fetched from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def status_left_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return catalog.with_status(docs, labels, ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def only_new_anti(spark, sf_dir):
    return catalog.only_new(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def only_fetched_semi(spark, sf_dir):
    return catalog.only_fetched(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""with u as (select doc_id, 0 as priority from labels where toxic = 1 union all select doc_id, 1 from labels where quality = 1 union all select doc_id, 2 from documents)
    select doc_id, min(priority)::int as priority from u group by doc_id""")
def priority_union_dedup(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    tables = [labels.filter("toxic = 1").select("doc_id"), labels.filter("quality = 1").select("doc_id"), docs.select("doc_id")]
    return catalog.by_priority(tables, "doc_id").select("doc_id", "priority")


@query("(select doc_id, 'added' as change from documents except select doc_id, 'added' from labels) union all (select doc_id, 'removed' from labels except select doc_id, 'removed' from documents)")
def set_difference_drift(spark, sf_dir):
    return catalog.drift(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select distinct x from (select lang as x from documents union all select source from documents)")
def titles_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(F.array("lang", "source"))).alias("x")).distinct()


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where strftime(o_orderdate, '%Y-%m-%d') >= '1995-03-07' and strftime(o_orderdate, '%Y-%m-%d') <= '1995-12-31'")
def date_range_filter(spark, sf_dir):
    """Dates of two spellings compared as normalised strings."""
    rows = table(spark, sf_dir, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return se.filtered(rows, since="1995年3月7日", until="1995-12-31").select("o_orderkey", F.col("date").alias("day"))


@query("""with c as (select unnest(generate_series(date '1995-12-31' - 60, date '1995-12-31', interval 1 day))::date as day), o as (select o_orderdate::date as day, count(*) as n from orders group by 1)
    select strftime(c.day, '%Y-%m-%d') as day, coalesce(o.n, 0) as n_orders from c left join o on c.day = o.day""")
def range_calendar(spark, sf_dir):
    """A range given in reverse and longer than sixty days is turned and cut."""
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= "1995-11-01") & (F.col("o_orderdate") < "1996-01-01")).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    days = catalog.calendar(spark, "1995-12-31", "1995-01-01")
    return days.join(orders, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("select doc_id, case when doc_id * 97 >= 30000 then 'shugiin' else 'sangiin' end as house from documents")
def id_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.house_of((F.col("doc_id") * 97).cast("string")).alias("house"))


@query("""select page_id, case when page_id % 2 = 0 then url || (case when contains(url, '?') then '&' else '?' end) || 'time=' || (page_id * 7)::varchar else url || '#' || (page_id * 7)::varchar end as jump from pages""")
def jump_url(spark, sf_dir):
    house = F.when(F.col("page_id") % 2 == 0, tx.LOWER_HOUSE).otherwise(tx.UPPER_HOUSE)
    return table(spark, sf_dir, "pages").select("page_id", tx.jump_url(house, F.col("url"), F.col("page_id") * 7 + 0.5).alias("jump"))


@query("select event_id, lpad((s // 3600)::varchar, 2, '0') || ':' || lpad((s // 60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as clock from (select event_id, floor(value * 37)::bigint as s from events)")
def hms_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.clock(F.col("value") * 37).alias("clock"))


@query("select conv_id, turn, case when length(text) > 140 then left(text, 139) || '…' else text end as text from conversations")
def ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.ellipsis(F.col("text")).alias("text"))


@query("select page_id, left(regexp_replace(regexp_replace(url, '[\\s　]+', '_', 'g'), '[\\\\/:*?\"<>|]', '', 'g'), 80) as name from pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("select conv_id, turn, replace(replace(replace(replace(url_encode(text), '+', '%20'), '%2F', '/'), '%7E', '~'), '*', '%2A') as code from conversations")
def percent_encoded(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.percent_encoded(F.col("text")).alias("code"))


@query("select page_id, 'https://records.example/?keyword=' || replace(replace(replace(replace(url_encode(url), '+', '%20'), '%2F', '/'), '%7E', '~'), '*', '%2A') as link from pages")
def record_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.record_url(F.col("url"), "https://records.example/?keyword=").alias("link"))


@query("select o_orderkey, case when o_orderkey % 5 = 4 then null else date_diff('day', o_orderdate::date, date '1999-01-01') end as days from orders")
def age_in_days(spark, sf_dir):
    """Dates in four spellings, one with something behind it, and one that is none of them. Two count
    as they are (`days_since`), the others once they are read as dates."""
    spelt = F.array(*[F.date_format("o_orderdate", p) for p in ("yyyy/M/d", "yyyy-MM-dd' (x)'", "yyyyMMdd", "yyyy年M月d日", "d MMM yyyy")])
    day = F.element_at(spelt, (F.col("o_orderkey") % 5 + 1).cast("int"))
    since = lambda d: tx.days_since(d, F.lit("1999-01-01").cast("date"))
    days = tx.once(day, lambda d: F.coalesce(since(d), tx.once(tx.any_date(d).cast("string"), since)))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.cast("long").alias("days"))


# ---- pages and cleaning -----------------------------------------------------------------


@query("""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title,
    len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) as n_links,
    coalesce(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)[1], '') as first_link from pages""")
def html_title_links(spark, sf_dir):
    found = tx.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", tx.tag_text(F.col("html"), "title").alias("title"), F.size(found).cast("long").alias("n_links"), F.coalesce(F.try_element_at(found, F.lit(1)).href, F.lit("")).alias("first_link"))


_PAIRS = {"the": "THE", "theration": "ration", "THE and": "and THE", "moron": "person", "idiot": "person"}


def _replace_sql(column: str) -> str:
    for a, b in sorted(_PAIRS.items(), key=lambda kv: -len(kv[0])):
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query(f"select doc_id, {_replace_sql('text')} as text, {_replace_sql('text')} <> text as changed from documents")
def glossary_replace(spark, sf_dir):
    new = tx.replaced(F.col("text"), _PAIRS)
    return table(spark, sf_dir, "documents").select("doc_id", new.alias("text"), (new != F.col("text")).alias("changed"))


@query("select doc_id, round(len(list_distinct(string_split(text, '')))::double / length(text), 6) as ratio, coalesce(length(text) > 200 and len(list_distinct(string_split(text, '')))::double / length(text) < 0.05, false) as is_loop from documents where length(text) > 0")
def unique_char_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return docs.select("doc_id", F.round(tx.unique_ratio(F.col("text")), 6).alias("ratio"), tx.is_loop(F.col("text")).alias("is_loop"))


_LOOPED = "coalesce(text, '') || ' ' || repeat(substr('ab cd', 1, (1 + doc_id % 4)::int), (8 + doc_id % 5)::int)"
_UNITS = (1, 2, 3, 4)
_LINE_ENDS = "(chr(10), chr(13), chr(133), chr(8232), chr(8233))"


def _loops_sql() -> str:
    """A backreference in SQL: from each character, how far the text repeats itself u characters on."""
    same = ", ".join(f"coalesce(c = lead(c, {u}) over w and c not in {_LINE_ENDS}, false) as same{u}" for u in _UNITS)
    run = ", ".join(f"min(case when not same{u} then i end) over (partition by doc_id order by i rows between current row and unbounded following) - i as run{u}" for u in _UNITS)
    size = "case " + " ".join(f"when run{u} >= {9 * u} then {u} * (1 + run{u} // {u})" for u in _UNITS) + " end"
    loop = "length(text) > 200 and len(list_distinct(string_split(text, '')))::double / length(text) < 0.05"
    return f"""
    with recursive d as (select doc_id, {_LOOPED} as text from documents),
    ch as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from d),
    s as (select doc_id, i, {same} from ch window w as (partition by doc_id order by i)),
    r as (select doc_id, i, {run} from s),
    m as (select doc_id, i, {size} as size from r where {" or ".join(f"run{u} >= {9 * u}" for u in _UNITS)}),
    walk as (select doc_id, min(i) as i, arg_min(size, i) as size from m group by doc_id
        union all select m.doc_id, min(m.i), arg_min(m.size, m.i) from walk join m on m.doc_id = walk.doc_id and m.i >= walk.i + walk.size group by m.doc_id),
    cut as (select ch.doc_id, ch.i, case when ch.i = walk.i then '{tx.UNCLEAR}' when ch.i < walk.i + walk.size then '' else ch.c end as c from ch asof left join walk on ch.doc_id = walk.doc_id and ch.i >= walk.i),
    joined as (select doc_id, string_agg(c, '' order by i) as made from cut group by doc_id)
    select doc_id, case when {loop} then '{tx.UNCLEAR}' else made end as text, case when {loop} then true else made <> text end as changed from d join joined using (doc_id)"""


@query(_loops_sql())
def inline_loop(spark, sf_dir):
    """Documents with a loop of 8 to 12 units at their end."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.repeat(F.substring(F.lit("ab cd"), F.lit(1), (1 + F.col("doc_id") % 4).cast("int")), (8 + F.col("doc_id") % 5).cast("int")))
    clean = tx.without_loops(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", clean.alias("text"), (clean != F.col("text")).alias("changed"))


_EDGE = "'" + tx.TRIMMED.replace("\t", "").replace("\n", "") + "' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SAID = "case when turn % 5 = 0 then 'ご視聴ありがとうございました。' when turn % 5 = 1 then repeat(role, 4) when turn % 5 = 2 then repeat('Thanks for watching', 2) else text end"


@query(f"""with t as (select conv_id, turn, trim(coalesce({_SAID}, ''), {_EDGE}) as t from conversations)
    select conv_id, turn, t <> '' and (t in {tx.INVENTED_PHRASES} or len(list_filter(range(2, 41), lambda u : length(t) % u = 0 and length(t) // u >= 3 and not contains(left(t, u), chr(10)) and repeat(left(t, u), length(t) // u) = t)) > 0
        or len(list_filter({list(tx.INVENTED_PHRASES)}, lambda p : contains(t, p) and trim(replace(t, p, ''), {_EDGE}) = '')) > 0) as invented from t""")
def hallucination_repeat(spark, sf_dir):
    """Turns, every fifth an invented phrase, every fifth a word over and over."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_invented(F.expr(_SAID)).alias("invented"))


def _cues(rows: DataFrame) -> DataFrame:
    """(conv_id, cues) of turns (conv_id, turn, said)."""
    cues = F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda c: F.struct(c.turn.cast("double").alias("start"), (c.turn + 1).cast("double").alias("end"), c.said.alias("text")))
    return rows.groupBy("conv_id").agg(cues.alias("cues"))


def _fold_sql(said: str, step: str, shown: str = "s.text") -> str:
    """SQL of a fold over each conversation's cues; `step` is the new list from `acc` and `x`."""
    return f"""
    with c as (select *, lag(text) over (partition by conv_id order by turn) as before from conversations),
    l as (select conv_id, list({{'start': turn::double, 'end': (turn + 1)::double, 'text': {said}}} order by turn) as cues from c group by conv_id),
    f as (select conv_id, list_reduce(list_transform(cues, lambda y : [y]), lambda acc, x : {step}) as kept from l),
    e as (select conv_id, unnest(kept) as s, generate_subscripts(kept, 1) - 1 as place from f)
    select conv_id, place::int as place, s.start as start, s."end" as "end", {shown} as text from e"""


_ENDING = "case when turn % 3 = 2 then ' と思います' when turn % 3 = 1 then ' です。' else '' end"
_ENDS = f"regexp_matches(regexp_replace(acc[-1].text, '[ \\t]+', '', 'g'), '(?:{'|'.join(tx.SENTENCE_ENDS)})[。！？]?$')"
_NO_BLANKS = "regexp_replace(s.text, '[ \\t]+', '', 'g')"


@query(_fold_sql(f"text || {_ENDING}", f"""case when {_ENDS} then list_concat(acc, x)
    else list_concat(acc[:-2], [{{'start': acc[-1].start, 'end': x[1]."end", 'text': acc[-1].text || x[1].text}}]) end""", f"case when {_NO_BLANKS} = '' or regexp_matches({_NO_BLANKS}, '[。！？]$') then {_NO_BLANKS} else {_NO_BLANKS} || '。' end"))
def sentence_merge(spark, sf_dir):
    """Turns, two of three ending a sentence, joined up to such ends."""
    merged = _cues(table(spark, sf_dir, "conversations").withColumn("said", F.expr(f"text || {_ENDING}"))).select("conv_id", at.merged_sentences(F.col("cues")).alias("s"))
    return merged.select("conv_id", F.posexplode("s").alias("place", "s")).select("conv_id", "place", "s.*")


_ROLLED = "case when turn % 4 = 1 then coalesce(right(before, 30), '') || ' 、' || text when turn % 4 = 2 then before else text end"
_MOST = "least(length(acc[-1].text), length(x[1].text), 200)"
_CUT = f"coalesce(list_max(list_filter(range(6, {_MOST} + 1), lambda n : suffix(acc[-1].text, left(x[1].text, n)))), 0)"
_REST = f"case when {_CUT} > 0 then ltrim(substr(x[1].text, {_CUT} + 1), ' 、。,.') else x[1].text end"


@query(_fold_sql(_ROLLED, f"""case when acc[-1].text = x[1].text then list_concat(acc[:-2], [{{'start': acc[-1].start, 'end': x[1]."end", 'text': acc[-1].text}}])
    when {_REST} = '' then acc else list_concat(acc, [{{'start': x[1].start, 'end': x[1]."end", 'text': {_REST}}}]) end"""))
def rolling_captions(spark, sf_dir):
    """Turns, some of which repeat the end or all of the one before."""
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("said", F.expr(_ROLLED))
    kept = _cues(rows).select("conv_id", at.without_rolling(F.col("cues")).alias("s"))
    return kept.select("conv_id", F.posexplode("s").alias("place", "s")).select("conv_id", "place", "s.*")


@query("""with p as (select doc_id, 'label ' || quality || toxic as new_text, quality * 2 + toxic as ord from labels), l as (select doc_id, arg_max(new_text, ord) as new_text from p group by doc_id)
    select d.doc_id, coalesce(l.new_text, d.text) as text, coalesce(l.new_text <> d.text, false) as changed from documents d left join l using (doc_id)""")
def patch_apply(spark, sf_dir):
    patches = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("new_text"), (F.col("quality") * 2 + F.col("toxic")).alias("ord"))
    return catalog.patched(table(spark, sf_dir, "documents").select("doc_id", "text"), patches, "doc_id", "text", "ord").select("doc_id", "text", "changed")


_ROLES = ("委員長", "理事", "財務大臣", "副大臣", "政府参考人", "内閣法制局長官", "警察庁次長", "議員", "", "_return")


def _role_sql(role: str) -> str:
    cases = "".join(f" when {' or '.join(f"contains({role}, '{p}')" for p in parts)} then '{name}'" for name, parts in tx.ROLE_CLASSES)
    return f"case when {role} = '{tx.RETURN}' then 'questioner'{cases} else 'other' end"


_ROLE_OF = f"list_extract({list(_ROLES)}, (conv_id * 7 + turn) % {len(_ROLES)} + 1)"


@query(f"select conv_id, turn, {_role_sql(_ROLE_OF)} as klass from conversations")
def role_classify(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, _ROLES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(_ROLES) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.role_class(role).alias("klass"))


@query("""select role, count(*) as n, count(distinct conv_id) as n_meetings, sum((length(text) > 200)::int)::bigint as n_long, sum(length(text))::bigint as n_chars from conversations group by role""")
def class_report(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_meetings"), F.sum((F.length("text") > 200).cast("long")).alias("n_long"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query("select max(doc_id) as last_id, arg_max(source, doc_id) as last_source, arg_min(source, doc_id) as first_source from documents where text is not null")
def id_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.agg(F.max("doc_id").alias("last_id"), F.max_by("source", "doc_id").alias("last_source"), F.min_by("source", "doc_id").alias("first_source"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date, case when lag(strftime(o_orderdate, '%Y-%m-%d')) over (order by strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, o_orderkey::varchar) is distinct from strftime(o_orderdate, '%Y-%m-%d') then true else false end as new_date
    from orders""")
def listing_dates(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("house"), F.col("o_orderkey").cast("string").alias("id"))
    return render.listing_lines(items).select("o_orderkey", "date", "new_date")


@query("""with i as (select strftime(o_orderdate, '%Y-%m-%d') as date, case when o_orderkey % 2 = 0 then 'sangiin' else 'shugiin' end as house, o_orderkey::varchar as id, o_orderpriority as title,
        case when o_orderkey % 3 = 0 then (o_orderkey % 7) || '時間' else '' end as duration, o_orderkey % 5 = 0 as fetched, 'https://l.example/' || o_orderkey as page_url, isodow(o_orderdate) as dow from orders),
    n as (select *, row_number() over (partition by date order by house, id) = 1 as first from i),
    l as (select date, house, id, list_filter([case when first then '── ' || date || ' (' || '月火水木金土日'[dow] || ') ──' end, '  [' || case when house = 'sangiin' then '参議院' else '衆議院' end || '] ' || title || case when duration <> '' then ' / ' || duration else '' end || case when fetched then ' ✓ 取込済' else '' end,
        '    id=' || id || '  get ' || id, '    ' || page_url], lambda x : x is not null) as lines from n),
    e as (select date, house, id, unnest(lines) as value, generate_subscripts(lines, 1)::int - 1 as line from l union all select null, null, null, '[' || count(*) || ' 件]', 0 from i)
    select *, row_number() over (order by date nulls first, house, id, line) as place from e""")
def listing_text(spark, sf_dir):
    """Lines of a listing with the place in which they come."""
    key = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(key % 2 == 0, "sangiin").otherwise("shugiin").alias("house"), key.cast("string").alias("id"), F.col("o_orderpriority").alias("title"),
        F.when(key % 3 == 0, F.concat((key % 7).cast("string"), F.lit("時間"))).otherwise("").alias("duration"), (key % 5 == 0).alias("fetched"), F.concat(F.lit("https://l.example/"), key.cast("string")).alias("page_url"),
    )
    # The place of each row as it comes: partitions are in order, and so are rows in them. Stored, as
    # made a second time to be counted the rows may come in other partitions.
    lines = stored(render.listing_text(items, "get").withColumn("at", F.monotonically_increasing_id()), "listing")
    sizes = lines.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = lines.withColumn("part", F.shiftright("at", 33)).join(before, "part")
    return found.select("date", "house", "id", "value", "line", (F.col("before") + F.col("at") % F.lit(1 << 33) + 1).alias("place"))


@query("select '{\"doc_id\":' || doc_id || ',\"quality\":' || coalesce(quality::varchar, 'null') || '}' as value from documents left join labels using (doc_id)")
def json_lines(spark, sf_dir):
    return render.json_lines(table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"))


# ---- status, records and calls ----------------------------------------------------------


@query("select doc_id, source as title from documents where doc_id not in (select doc_id from labels) and contains(source, 'src1') order by doc_id limit 10")
def suggestions(spark, sf_dir):
    """Ten items not fetched whose title has the query's first word."""
    items = catalog.with_status(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title")), table(spark, sf_dir, "labels"), ["doc_id"])
    return catalog.suggestions(items, '"src1" moron', order=("doc_id",)).select("doc_id", "title")


@query("select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders where o_orderdate::date between date '1995-12-24' and date '1995-12-31' group by 1")
def listing_range(spark, sf_dir):
    """The week up to today, as listings without dates have it."""
    since, until = catalog.listing_range(date(1995, 12, 31))
    rows = se.filtered(table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate")), since=since.isoformat(), until=until.isoformat())
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("""with f as (select doc_id, 'meta' as kind from labels union all select doc_id, 'html' from labels where quality = 1)
    select doc_id from documents where doc_id not in (select doc_id from f group by doc_id having count(distinct kind) = 2)""")
def unfinished(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    files = labels.select("doc_id", F.lit("meta").alias("kind")).unionByName(labels.filter("quality = 1").select("doc_id", F.lit("html").alias("kind")))
    return catalog.unfinished(table(spark, sf_dir, "documents").select("doc_id"), files, ["doc_id"], ["meta", "html"])


@query(f"""select lang, sum((length(text) > 200 and len(list_distinct(string_split(text, '')))::double / length(text) < 0.05)::int)::bigint as loops, coalesce(sum(({_replace_sql('text')} <> text)::int), 0)::bigint as glossary,
    sum((text is null)::int)::bigint as missing from documents group by lang""")
def change_counts(spark, sf_dir):
    text = F.col("text")
    return catalog.changes(table(spark, sf_dir, "documents"), "lang", loops=tx.is_loop(text), glossary=tx.replaced(text, _PAIRS) != text, missing=text.isNull())


@query("""with t as (select doc_id, replace(replace(replace(replace(replace(text, 'theration', 'ration'), 'THE and', 'and THE'), 'moron', 'person'), 'idiot', 'person'), 'the', 'THE') as new, text from documents where text is not null),
    l as (select *, length(text) > 200 and len(list_distinct(string_split(text, ''))) / length(text) < 0.05 as loop from t)
    select (select count(*) from documents) as n_rows, count(*) filter (not loop and new <> text) as n_glossary, count(*) filter (loop) as n_loops from l""")
def cleaning_counters(spark, sf_dir):
    """Counters of a run from the pass that writes it."""
    path = new_path(spark, "cleaned")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen, counters = catalog.observed(docs, "counters", loops=tx.is_loop(F.col("text")), glossary=~tx.is_loop(F.col("text")) & (tx.replaced(F.col("text"), _PAIRS) != F.col("text")))
    seen.write.parquet(path)
    segments.clear(spark, path)
    found = counters.get
    return spark.createDataFrame([(found["rows"], found["glossary"], found["loops"])], "n_rows long, n_glossary long, n_loops long")


@query("select conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as text from conversations")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.html_escaped(F.col("text")).alias("text"))


@query("select event_id, case when s >= 3600 then (s // 3600) || '時間' || (s // 60 % 60) || '分' when s >= 60 then (s // 60) || '分' || (s % 60) || '秒' else s || '秒' end as label from (select event_id, floor(value * 37)::bigint as s from events)")
def duration_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.duration_label(F.col("value") * 37).alias("label"))


@query("""with b as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1) // 8 as batch, (row_number() over (partition by conv_id order by turn) - 1) % 8 as id, turn, text from conversations)
    select conv_id, batch, to_json({'cues': list({'id': id, 'text': text} order by turn), 'context': 'conv ' || conv_id})::varchar as value from b group by conv_id, batch""")
def correction_requests(spark, sf_dir):
    """Turns in requests of eight, with what they belong to."""
    turns = table(spark, sf_dir, "conversations")
    return prompts.correction_requests(turns, "conv_id", "turn", "text", F.concat(F.lit("conv "), F.col("conv_id").cast("string")))


@query("""with t as (select conv_id, turn, unnest(generate_series(0, turn % 3)) as i from conversations)
    select conv_id * 1000 + turn as meeting, i::int as i, to_json({'type': 'speaker', 'i': i, 'start': turn * 10.0::double + i, 'name': 'n' || i, 'group': case when i = 1 then null else 'g' end})::varchar as value from t""")
def speaker_events(spark, sf_dir):
    one = lambda i: F.struct((F.col("turn") * 10.0 + i).alias("start"), F.concat(F.lit("n"), i.cast("string")).alias("name"), F.when(i != 1, "g").alias("group"))
    meetings = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("meeting"), F.transform(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int")), one).alias("speakers"))
    return render.speaker_events(meetings, "meeting")


_SID_HTML = "'<dl><dt>開会日</dt><dd>' || case when page_id % 5 = 0 then '' else '2026年' || (page_id % 12 + 1) || '月3日' end || '</dd><dt>会議名</dt><dd> 委員会' || page_id || '</dd></dl>' || html"


@query(f"""select page_id, case when page_id % 5 = 0 then '' else '2026-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-03' end as date, '委員会' || page_id as name, length({_SID_HTML}) >= 500 and page_id % 5 <> 0 as valid from pages""")
def sid_pages(spark, sf_dir):
    return catalog.sid_pages(table(spark, sf_dir, "pages").withColumn("html", F.expr(_SID_HTML)), "page_id")


@query("select max(page_id) as page_id from pages where page_id % 5 <> 0")
def last_sid(spark, sf_dir):
    return catalog.last_known(table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5 != 0).alias("valid")), "page_id")


@query("select page_id, 'p' || page_id as name from pages where page_id % 5 <> 0 and page_id % 12 = 3")
def sids_on(spark, sf_dir):
    known = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), (F.col("page_id") % 5 != 0).alias("valid"), F.when(F.col("page_id") % 12 == 3, "2026-04-03").otherwise("2026-05-03").alias("date"))
    return catalog.ids_on(known, "2026-04-03", "page_id")


# A page of the upper house: links in a table of contents and in a footnote are no speakers.
_UPPER_PAGE = """'<a href="#1">目次</a><script src="x.js"></script><SCRIPT async src="https://public.mediasp.jp/v1/player?hash=' || page_id || '"></script><dt>開会日</dt><dd>2026年5月' || (page_id % 28 + 1) || '日</dd><dt>会議名</dt><dd> 委員会' || page_id || ' </dd><h3>資料</h3><ul><a href="#2">資料</a></ul><h3 class="t"> 発言者一覧 </h3> <ul>' || repeat('<li><a href="#30.5">乙（会派）</a></li>', (page_id % 3)::int) || '<li><a class="s" href="#10">甲(議長)</a></li></ul><p><a href="#99">注</a></p>' || html"""


@query("""select page_id, 'https://public.mediasp.jp/v1/player?hash=' || page_id as player_url, case when page_id % 2 = 0 then 'https://c.example/' || page_id || '.vtt' else '' end as caption_url,
    'https://v.example/' || page_id || '.m3u8' as m3u8, '2026年5月' || (page_id % 28 + 1) || '日' as date, '委員会' || page_id as title, '甲/議長' || repeat(',乙/会派', (page_id % 3)::int) as speakers from pages""")
def upper_detail(spark, sf_dir):
    script = F.concat(F.lit('p({url:"https://v.example/'), F.col("page_id").cast("string"), F.lit('.m3u8"'), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(',captionUrl:"https://c.example/'), F.col("page_id").cast("string"), F.lit('.vtt"'))).otherwise(""), F.lit("})"))
    found = table(spark, sf_dir, "pages").select("page_id", pages.upper_detail(F.expr(_UPPER_PAGE), script, F.col("url")).alias("d"))
    speakers = F.array_join(F.transform("d.speakers", lambda s: F.concat(s["name"], F.lit("/"), s["group"])), ",")
    return found.select("page_id", "d.player_url", "d.caption_url", "d.m3u8", "d.date", "d.title", speakers.alias("speakers"))


_SIDS = "date '2026-01-01' + ((page_id // 7) * 2)::int"


@query(f"""with k as (select page_id * 3 as sid, {_SIDS} as date from pages where page_id % 5 <> 0 and page_id % 49 <> 8), d as (select distinct {_SIDS} + (page_id % 3)::int as day from pages),
    b as (select day, (select arg_max(sid, (date, sid)) from k where date < day) as low, (select max(date) from k where date < day) as low_day, (select arg_min(sid, (date, sid)) from k where date > day) as high, (select min(date) from k where date > day) as high_day,
        (select min(sid) from k where date = day) as own, (select max(sid) from k) as last from d where day <= (select max(date) from k)),
    s as (select day, coalesce(low + 1, 1) as a, coalesce(high - 1, last) as z, coalesce(own, case when low is not null and high is not null
        then least(greatest(low + greatest(1, floor((high - low) * ((day - low_day) / greatest(1, high_day - low_day)::double))::bigint), low + 1), high - 1)
        when low is not null then low + greatest(1, (day - low_day) * 4) else greatest(1, high - greatest(1, (high_day - day) * 4)) end) as seed from b),
    c as (select day, seed + o as sid, o from s, unnest(range(-50, 51)) t(o) where seed + o between a and z)
    select day::varchar as day, (row_number() over (partition by day order by abs(o), o desc))::int as rank, sid from c anti join k using (sid)""")
def sid_candidates(spark, sf_dir):
    """Unknown ids that may belong to a day, from the nearest known ids on either side."""
    found = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.floor(F.col("page_id") / 7) * 2).cast("int"))
    known = found.filter("page_id % 5 <> 0 and page_id % 49 <> 8").select((F.col("page_id") * 3).alias("sid"), day.alias("date"))
    days = found.select(F.date_add(day, (F.col("page_id") % 3).cast("int")).alias("day"))
    return catalog.id_candidates(known, days).select(F.col("day").cast("string").alias("day"), "rank", "sid")


# Four ways to open a speech: a call, a mention, a call of two words, a return to the questioner.
_OPENED = ("山田財務大臣お答えします。", "山田大臣に伺います。", "三浦審議官はい、", "鈴木花子君次に、")
_OPEN_SQL = f"{list(_OPENED)}[turn % 4 + 1]"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.element_at(F.array(*map(F.lit, _OPENED)), (F.col("turn") % 4 + 1).cast("int")), "text"))
    names = F.array(*map(F.lit, ("山田", "三浦", "鈴木花子", "鈴木", "今")))
    return spoken.select((F.col("conv_id") * 1000 + F.col("turn")).alias("section"), "text", F.lit("鈴木花子").alias("primary"), calls.speaker_calls(F.col("text"), names).alias("calls"))


@query("""with c as (select conv_id * 1000 + turn as section, turn % 4 as k, length(text) as start from conversations)
    select section, start::int as start, ['山田', '', '三浦', '鈴木花子'][k + 1] as name, ['財務大臣', '', '審議官', '_return'][k + 1] as role_str from c where k <> 1""")
def speaker_calls(spark, sf_dir):
    found = _sections(spark, sf_dir).select("section", F.explode("calls").alias("c"))
    return found.select("section", "c.start", "c.name", "c.role_str")


@query(f"""with c as (select conv_id * 1000 + turn as section, turn % 4 as k, text, {_OPEN_SQL} as o from conversations),
    p as (select section, 0 as place, '鈴木花子' as speaker, 'questioner' as klass, case when k = 1 then text || o || text else text end as text from c
    union all select section, 1, case k when 0 then '山田' when 2 then '三浦' else '鈴木花子' end, case k when 0 then 'minister' when 2 then 'bureaucrat' else 'questioner' end, o || text from c where k <> 1)
    select section, place::int as place, speaker, klass, trim(text, ' 　' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text from p""")
def call_turns(spark, sf_dir):
    """Sections cut at their calls."""
    return prompts.turns(_sections(spark, sf_dir), "section", "text", "primary", "calls").select("section", F.col("at").alias("place"), "speaker", "klass", "text")


# Openings with (name, role) of their call, if they have one: titles of any length and script, what
# is no call, several names in a row.
_CALLS = (
    ("山田国土交通省総合政策局長お答えします。", "山田", "国土交通省総合政策局長"), ("山田大臣に伺います。", None, None), ("はい。三浦審議官はい、", "三浦", "審議官"),
    ("鈴木花子君次に、", "鈴木花子", "_return"), ("木原、大臣お答え。", None, None), ("では内閣府特命担当大臣、高橋桃子参考人です。", "高橋桃子", "参考人"),
    ("今大臣。", None, None), ("阿部こども家庭庁長官よろしく。", "阿部", "こども家庭庁長官"),
)
_CALL_ROSTER = ("山田", "三浦", "鈴木", "花子", "木原", "高橋", "高橋桃子", "阿部", "今", "先")
_CALL_SQL = ", ".join(f"({k}, '{o}', {f"'{n}'" if n else 'null'}, {f"'{r}'" if n else 'null'}, {o.index(n) if n else 0})" for k, (o, n, r) in enumerate(_CALLS))
_SECTION_SQL = f"""k as (select * from (values {_CALL_SQL}) t(k, o, name, role_str, off)),
    c as (select conv_id * 1000 + turn as section, text, k.* from conversations join k on (conv_id * 3 + turn) % 8 = k.k)"""


def _called_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.element_at(F.array(*[F.lit(o) for o, _, _ in _CALLS]), ((F.col("conv_id") * 3 + F.col("turn")) % 8 + 1).cast("int"))
    spoken = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("section"), F.concat("text", opened, "text", opened).alias("text"), F.lit("鈴木花子").alias("primary"), F.lit("甲党").alias("group"))
    return calls.roster_calls(spoken, "text", spark.createDataFrame([(n,) for n in _CALL_ROSTER], "name string"))


@query(f"""with {_SECTION_SQL} select section, (length(text) + off)::int as start, name, role_str from c where name is not null
    union all select section, 2 * length(text) + length(o) + off, name, role_str from c where name is not null""")
def roster_calls(spark, sf_dir):
    """By one automaton over the names of a roster."""
    return _called_sections(spark, sf_dir).select("section", F.explode("calls").alias("c")).select("section", "c.start", "c.name", "c.role_str")


_TRIMMED = "trim({}, ' 　' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""with {_SECTION_SQL},
    p as (select section, name, role_str, {_TRIMMED.format('text || o[:off]')} as head, {_TRIMMED.format('o[off + 1:] || text || o[:off]')} || ' ' || {_TRIMMED.format('o[off + 1:]')} as rest, {_TRIMMED.format('text || o || text || o')} as whole from c)
    select section, '鈴木花子' as speaker, 'questioner' as klass, '議員' as role, '甲党' as party, case when name is null then whole when role_str = '_return' then head || ' ' || rest else head end as text from p
    union all select section, name, 'bureaucrat', role_str, '', rest from p where name is not null and role_str <> '_return'""")
def merged_turns(spark, sf_dir):
    """Two calls of one speaker in a row make one turn."""
    turned = prompts.turns(_called_sections(spark, sf_dir), "section", "text", "primary", "calls", "group")
    return prompts.merged_turns(turned, "section").select("section", "speaker", "klass", "role", F.col("group").alias("party"), "text")


@query(f"""select role, count(*) as n from ({ORACLES['merged_turns']}) group by role order by n desc, role limit 20""")
def frequent_roles(spark, sf_dir):
    turned = prompts.merged_turns(prompts.turns(_called_sections(spark, sf_dir), "section", "text", "primary", "calls", "group"), "section")
    return prompts.smoke_report(turned, "section", "text")[0]


@query(f"""select distinct speaker from ({ORACLES['merged_turns']}) where klass <> 'questioner'""")
def respondents(spark, sf_dir):
    turned = prompts.merged_turns(prompts.turns(_called_sections(spark, sf_dir), "section", "text", "primary", "calls", "group"), "section")
    return prompts.smoke_report(turned, "section", "text")[1]


@query("""with t as (select conv_id, sum(length(text)) as n_chars, bool_or(role = 'assistant') as answered from conversations group by conv_id)
    select conv_id, n_chars::bigint as n_chars from t where not answered and n_chars > 200""")
def silent_sections(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("klass", F.when(F.col("role") == "assistant", "minister").otherwise("questioner")).withColumn("speaker", F.col("role"))
    return prompts.smoke_report(turns, "conv_id", "text")[2]


@query("""with f as (select conv_id, turn, text, case when conv_id % 3 = 1 then 'new' else 'old' end as state from conversations where conv_id % 4 <> 3)
    select conv_id::varchar as path, turn::int as cue_idx, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as n_tokens, state from (select *, row_number() over (partition by conv_id order by turn) - 1 as place from f) where place = turn""")
def token_refresh(spark, sf_dir):
    """A token table after some files have changed and others have gone."""
    of_file = _cues(table(spark, sf_dir, "conversations").withColumn("said", F.col("text"))).select(F.col("conv_id").cast("string").alias("path"), "conv_id", "cues")
    before = of_file.select("path", F.lit(1).alias("mtime"), "cues")
    now = of_file.filter("conv_id % 4 <> 3").select("path", F.when(F.col("conv_id") % 3 == 1, 2).otherwise(1).alias("mtime"), "cues")
    held = tokens.refreshed(now, tokens.refreshed(before, None))
    return held.select("path", "cue_idx", F.size("tokens").cast("long").alias("n_tokens"), F.when(F.col("mtime") == 2, "new").otherwise("old").alias("state"))


# ---- readers and prompts ----------------------------------------------------------------


@query("select count(*) as n, min(turn) as first_turn from conversations where contains(role, 'assist')")
def speaker_filter(spark, sf_dir):
    rows = se.filtered(table(spark, sf_dir, "conversations").withColumn("speaker_name", F.col("role")), speaker="assist")
    return rows.agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("select conv_id, (turn - min(turn) over (partition by conv_id))::int as place, turn + (turn * 7 % 1000) / 1000.0::double as start, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations where regexp_matches(text, '\\S')")
def caption_file(spark, sf_dir):
    """Turns written as a caption file and read again."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    stamp = F.concat(F.lit("0:"), two(F.floor(F.col("turn") / 60)), F.lit(":"), two(F.col("turn") % 60), F.lit("."), F.lpad((F.col("turn") * 7 % 1000).cast("string"), 3, "0"))
    block = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp, F.lit(" --> "), stamp, F.lit("\n"), F.btrim(F.regexp_replace("text", r"\s+", " ")))
    files = at.ordered_text(table(spark, sf_dir, "conversations").withColumn("block", block), "conv_id", "turn", "block", "\n\n")
    cues = files.select("conv_id", F.posexplode(captions.caption_cues(F.concat(F.lit("WEBVTT\n\n"), F.col("block")))).alias("place", "cue"))
    return cues.select("conv_id", "place", "cue.start", "cue.text")


@query("""with m as (select conv_id, count(*) as n, list(distinct role order by role) as roles from conversations group by conv_id),
    t as (select conv_id, '会議' || conv_id || '（2026-05-01）。' as head, '発言者: ' || array_to_string(roles, '、') || '。' as who, '議題: 財務金融。' as what from m)
    select conv_id, head || chr(10) || who || case when length(head) + length(who) + length(what) <= 60 then chr(10) || what else '' end as prompt from t""")
def prompt_tiers(spark, sf_dir):
    """The most important lines of each meeting that fit into sixty characters."""
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    speakers = F.transform("roles", lambda r: F.struct(F.lit(0.0).alias("start"), r.alias("name"), F.lit("委員長").alias("group")))
    lines = prompts.tiers(F.concat(F.lit("会議"), F.col("conv_id").cast("string")), F.lit("2026-05-01"), speakers, F.array(F.lit("財務金融に関する件")), F.array().cast("array<string>"))
    return roles.select("conv_id", prompts.within(lines, 60).alias("prompt"))


_DETAIL = (
    "'<td>予算委員会 (' || page_id || '時間)</td> 2026年5月' || (page_id % 28 + 1) || '日 <a href=\"i?deli_id=1&time=20.5\">山田(会派' || page_id || ')</a><a href=\"i?time=3\">乙</a><a href=\"i?time=20.52\">山田(会派)</a>"
    "<td width=\"595\" bgcolor=\"#CCCCFF\">議題 <b>' || page_id || '</b></td><input id=\"vtag_src_base_vod\" value=\"http://v/' || page_id || '.m3u8\">' || html"
)


@query("""select page_id, page_id::varchar as deli_id, 'https://v/' || page_id || '.m3u8' as m3u8, '2026-05-' || lpad((page_id % 28 + 1)::varchar, 2, '0') as date, '予算委員会' as title,
    '3.0 乙 ;20.5 山田 会派' || page_id as speakers, '議題 ' || page_id as agenda from pages""")
def lower_detail(spark, sf_dir):
    """Pages with a recording's details in front."""
    x = pages.lower_detail(F.expr(_DETAIL), F.concat(F.lit("http://x/?deli_id="), F.col("page_id").cast("string")))
    found = table(spark, sf_dir, "pages").select("page_id", x.alias("x"))
    said = F.array_join(F.transform("x.speakers", lambda s: F.concat_ws(" ", s.start.cast("string"), s["name"], s["group"])), ";")
    return found.select("page_id", "x.deli_id", "x.m3u8", "x.date", "x.title", said.alias("speakers"), F.element_at("x.agenda", 1).alias("agenda"))


_LISTED = "'<table><tr><td><a href=\"i?deli_id=' || page_id || '\">本会議</a></td><td class=\"s14_24\">' || page_id || '分</td><tr><td><a href=\"i?deli_id=7\">会見</a><td class=\"s14_24\">1分</td><a href=\"i?deli_id=' || page_id || '\">本会議</a><td class=\"s14_24\">2分</td></table>' || html"


@query("select page_id, page_id::varchar as id, '本会議' as title, page_id || '分' as duration from pages")
def daily_listing(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(pages.daily_listing(F.expr(_LISTED))).alias("x"))
    return found.select("page_id", "x.id", "x.title", "x.duration")


_ROSTER = "'<TD class=\"shu2td5\"><TT>氏名</TT></TD><TD class=\"shu2td6\"><TT>ふりがな</TT></TD><TD class=\"shu2td7\"><TT>選挙区</TT></TD><TD class=\"shu2td5\"><TT>甲　' || page_id || '君</TT></TD><TD class=\"shu2td6\"><TT>こう</TT></TD><TD class=\"shu2td7\"><TT>東京' || page_id || '</TT></TD>' || html"


@query("select page_id, '甲' || page_id as name, '甲　' || page_id as name_with_spaces, 'こう' as furigana, '東京' || page_id as district from pages")
def roster(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(pages.members(F.expr(_ROSTER))).alias("x"))
    return found.select("page_id", "x.name", "x.name_with_spaces", "x.furigana", "x.district")


@query("""with t as (select conv_id, turn, case turn % 3 when 0 then '{"corrections":[{"id":1,"text":"a"},{"id":"x"}]}' when 1 then '```json\n[{"id":2,"text":"b"}]\n```' else text end as raw from conversations)
    select conv_id, turn, case turn % 3 when 0 then 1 else 2 end as id, case turn % 3 when 0 then 'a' else 'b' end as text from t where turn % 3 < 2""")
def response_corrections(spark, sf_dir):
    """Responses as an object, as a fenced array, and as something else."""
    raw = F.when(F.col("turn") % 3 == 0, '{"corrections":[{"id":1,"text":"a"},{"id":"x"}]}').when(F.col("turn") % 3 == 1, '```json\n[{"id":2,"text":"b"}]\n```').otherwise(F.col("text"))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(pages.corrections(raw)).alias("x"))
    return found.select("conv_id", "turn", "x.id", "x.text")
