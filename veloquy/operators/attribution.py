"""Who speaks when: as-of and interval joins, durations, runs of turns, folds over captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloquy.functions.text import ends_sentence, punctuated
from veloquy.storage import stored


def by_start(speakers: Column) -> Column:
    """An array of struct(start, ...) in order of start, equal starts as they stood."""
    return F.transform(F.array_sort(F.transform(speakers, lambda s, i: F.struct(s.start.alias("k"), i.alias("i"), s.alias("s")))), lambda x: x.s)


def speaker_at(speakers: Column, start: Column, ordered: bool = False) -> Column:
    """The last of an array of struct(start, ...) that starts at or before `start`; the first
    one if none does; null without speakers. Equal starts: the later one. `ordered`: the array
    comes from `by_start`, so that the cues of a meeting needn't sort it again."""
    known = speakers if ordered else by_start(speakers)
    before = F.filter(known, lambda s: s.start <= start)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(known, F.lit(1)))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str], clamp: bool = True) -> DataFrame:
    """`left` with the columns `value` of the last row of `right` in the same `by` group at or
    before `at`; with `clamp`, rows before the first one get the first. Tables of any size: one
    shuffle by group and a running window, no pairs."""
    names = [f"__v{i}" for i in range(len(value))]
    a = left.select(by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__v"))
    payload = F.struct(*[F.col(v).alias(n) for v, n in zip(value, names, strict=True)])
    b = right.select(by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), payload.alias("__v"))
    both = a.withColumn("__v", F.lit(None).cast(b.schema["__v"].dataType)).unionByName(b)
    order = Window.partitionBy(by).orderBy("__at", "__side")
    found = F.last("__v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if clamp:
        found = F.coalesce(found, F.first("__v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = both.withColumn("__found", found).filter("__side = 1")
    return out.select("__row.*", *[F.col(f"__found.{n}").alias(v) for v, n in zip(value, names, strict=True)])


def _both_sides(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str], tie: str | None) -> DataFrame:
    """Rows of both tables: (__by, __at, __side, __tie, __row, __v), side 0 for `right`."""
    rank = lambda df: F.col(tie) if tie else F.lit(0)
    payload = F.struct(*[F.col(v).alias(f"__v{i}") for i, v in enumerate(value)])
    b = right.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(0).alias("__side"), rank(right).alias("__tie"), payload.alias("__v"))
    a = left.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(b.schema["__tie"].dataType).alias("__tie"), F.struct(*left.columns).alias("__row"))
    a = a.withColumn("__v", F.lit(None).cast(b.schema["__v"].dataType))
    return a.unionByName(b.withColumn("__row", F.lit(None).cast(a.schema["__row"].dataType)))


def as_of_ranges(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str], clamp: bool = True, tie: str | None = None) -> DataFrame:
    """As `as_of`, for groups of any size: rows are dealt by ranges of (group, time), so one group
    may lie in many tasks. Each range is summed up to its last row of `right` for each group; a
    pass over these few rows (one for each group and each range it lies in) carries the last one of
    the ranges before into each; then a row looks at its own range, and at what was carried where
    nothing stands before it there. Rows of `right` at the same time are taken in order of `tie`.
    Null groups are one group; rows with a null time come before all others."""
    dealt = stored(_both_sides(left, right, by, at, value, tie).repartitionByRange("__by", "__at", "__side", "__tie").withColumn("__part", F.spark_partition_id()), "ranges")
    order = F.when(F.col("__side") == 0, F.struct("__at", "__tie"))
    ends = dealt.groupBy("__by", "__part").agg(F.max_by("__v", order).alias("__last"), F.min_by("__v", order).alias("__first"))
    parts = Window.partitionBy("__by").orderBy("__part")
    carried = ends.select(
        F.col("__by").alias("__b"), F.col("__part").alias("__p"), F.last("__last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"),
        F.first("__first", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__start"),
    )
    local = Window.partitionBy("__part", "__by").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__own", F.last("__v", ignorenulls=True).over(local)).filter("__side = 1").select("__by", "__part", "__row", "__own")
    found = found.join(carried, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__part") == F.col("__p")))
    best = F.coalesce("__own", "__carried", *(["__start"] if clamp else []))
    found = found.select("__row", best.alias("__found"))
    return found.select("__row.*", *[F.col(f"__found.__v{i}").alias(v) for i, v in enumerate(value)])


def with_next(rows: DataFrame, by: str, at: str, name: str = "next_start", *tie: str) -> DataFrame:
    """`rows` with the next start of their group; rows of equal start in order of `tie`."""
    return rows.withColumn(name, F.lead(at).over(Window.partitionBy(by).orderBy(at, *tie)))


def interval_groups(cues: DataFrame, speakers: DataFrame, by: str, at: str, speaker_key: str, text: str, tie: str) -> DataFrame:
    """Every speaker with the cues from its start up to the next one's: (by, speaker_key, n_cues,
    text). Cues before the first speaker are dropped; speakers without cues stay."""
    owned = as_of(cues.select(by, at, tie, text), speakers.select(by, at, speaker_key), by, at, [speaker_key], clamp=False).filter(F.col(speaker_key).isNotNull())
    joined = owned.groupBy(by, speaker_key).agg(F.count("*").alias("n_cues"), F.array_sort(F.collect_list(F.struct(at, tie, F.col(text).alias("__t")))).alias("__all"))
    text_of = F.array_join(F.transform("__all", lambda x: x["__t"]), " ")
    joined = joined.select(by, speaker_key, "n_cues", text_of.alias(text))
    return speakers.select(by, speaker_key).join(joined, [by, speaker_key], "left").select(by, speaker_key, F.coalesce("n_cues", F.lit(0).cast("long")).alias("n_cues"), F.coalesce(text, F.lit("")).alias(text))


def runs(rows: DataFrame, by: str, order: str, same: list[str], text: str) -> DataFrame:
    """Neighbouring rows equal in `same` merged: (by, run, *same, n, text)."""
    w = Window.partitionBy(by).orderBy(order)
    change = [~F.lag(c).over(w).eqNullSafe(F.col(c)) for c in same]
    first = F.row_number().over(w) == 1
    step = (first | change[0]) if len(change) == 1 else (first | change[0] | change[1])
    marked = rows.withColumn("__new", step.cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(by, "run", *same).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("__t")))).alias("__all"))
    return out.select(by, "run", *same, "n", F.array_join(F.transform("__all", lambda x: x["__t"]), " ").alias(text))


def ordered_text(rows: DataFrame, by: str, order: str, text: str, joiner: str = "\n") -> DataFrame:
    out = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("__t")))).alias("__all"))
    return out.select(by, F.array_join(F.transform("__all", lambda x: x["__t"]), joiner).alias(text))


def merged_sentences(cues: Column) -> Column:
    """array<struct<start, end, text>> with neighbours joined until the joined text ends a
    sentence, then punctuated. A fold: the test looks at all that has been joined so far."""
    empty = F.slice(cues, 1, 0)

    def step(done: Column, cue: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fresh = F.size(done) == 0
        cut = fresh | F.coalesce(ends_sentence(last.text), F.lit(True))
        longer = F.struct(last.start.alias("start"), cue.end.alias("end"), F.concat(last.text, cue.text).alias("text"))
        return F.when(cut, F.concat(done, F.array(F.struct(cue.start.alias("start"), cue.end.alias("end"), cue.text.alias("text"))))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.transform(F.aggregate(cues, empty, step), lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), punctuated(c.text).alias("text")))


def without_rolling(cues: Column, longest: int = 200, least: int = 6) -> Column:
    """Rolling captions undone, in start order: equal text extends the one before; a start that
    repeats the end of what was kept before (`least` to `longest` characters) is cut off."""
    empty = F.slice(cues, 1, 0)

    def step(done: Column, cue: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        cue3 = lambda text: F.struct(cue.start.alias("start"), cue.end.alias("end"), text.alias("text"))
        most = F.least(F.length(last.text), F.length(cue.text), F.lit(longest))
        cut = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: (n >= least) & (n <= most) & last.text.endswith(F.substring(cue.text, F.lit(1), n)))), F.lit(0))
        rest = F.when(cut > 0, F.regexp_replace(F.substring(cue.text, cut + 1, F.length(cue.text)), "^[ 、。,.]+", "")).otherwise(cue.text)
        held = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        extended = F.concat(held, F.array(F.struct(last.start.alias("start"), cue.end.alias("end"), last.text.alias("text"))))
        return F.when(F.size(done) == 0, F.array(cue3(cue.text))).when(last.text == cue.text, extended).when(rest == "", done).otherwise(F.concat(done, F.array(cue3(rest))))

    return F.aggregate(cues, empty, step)
