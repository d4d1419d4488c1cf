"""Mixing sources to target weights by capped water-filling, in built-in functions only.

Each source should get its weight's share of all words, but at most `epochs` times what it has;
what a capped source can't take is reshared among the others by weight until none is above its
cap. In order of cap / weight the capped sources come first, so the rounds reduce to one pass:
source s is capped exactly if cap_s / weight_s is at most the level that would fill it and all
later ones. A source's target is met by whole repetitions of all its documents and a seeded
sample of them once more (or, for more than half of a source's words, all but a sample):
documents in order of a keyed hash up to a cut. Of the AROUND documents
about the cut that set is taken whose sum comes nearest to what is left, by the sums of all their
subsets; so a source of no more documents than that has the best subset there is. Or, if that comes
nearer, the set of the greatest sum below, filled up in the same way by documents behind those that
are no larger than what is missing. The place to cut is first narrowed to one of HASH_CELLS cells by pre-aggregated sums, so that
only the cells about it are ever sorted, however large the source.

The plan has one row for each source and is the only thing joined to the documents: texts move
only if Spark finds the plan too large to broadcast by its written size.

Defined results: null text has size 0; the null source is a source of its own, last in order.
Sources without words have target 0. Identical rows share a hash, but are taken one by one: where
only some of them are, these are chosen by the partitions in which they lie. An
empty table gives an empty result. Other columns are carried along in `mixed`, but one named `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, numbered, renamed, stored

EPOCHS = 3
HASH_CELLS = 4096
#: Documents about the cut that are chosen by the sums of all their subsets (2**AROUND of them).
AROUND = 14
SEED = 20240607


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """`sources` with weight 1, 2, ... cycle, repeating by code point of the source, null last."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("double"))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """`sources` (source, source_size, weight) with `target`; one row for each source."""
    cap = (epochs * F.col("source_size")).cast("double")
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    all_rows = Window.partitionBy()
    level = (F.col("total") - F.col("earlier")) / F.col("later")
    out = sources.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    out = out.withColumn("earlier", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("later", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("level", level)
    out = out.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    return out.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final).alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _about_the_cut(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, more, base, below, above, groups): rows (source, size, mark) of marks under `below`
    sum to `base`; `groups` are those of marks from `below` to `above`, the AROUND rows where the sum in
    order of marks passes `more` of `needs` (source, more), as (mark, size, n, fixed, near): of n equal
    rows `fixed` lie under these AROUND and `near` among them."""
    cell = F.shiftrightunsigned("mark", 52).cast("int").bitwiseXOR(F.lit(HASH_CELLS // 2))
    rows = rows.withColumn("cell", cell)
    cells = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "cells")
    up_to = Window.partitionBy("source").orderBy("cell")
    cells_to = cells.withColumns({"size_to": F.sum("size").over(up_to), "n_to": F.sum("n").over(up_to)})
    cells_to = cells_to.join(needs.select(F.col("source").alias("s"), "more"), _same("source", "s")).drop("s")
    full = F.col("size_to") <= F.col("more")
    split = cells_to.groupBy(F.col("source").alias("s")).agg(F.coalesce(F.max(F.when(full, F.col("n_to"))), F.lit(0)).alias("n_from"), F.coalesce(F.min(F.when(~full, F.col("n_to"))), F.max("n_to")).alias("n_until"))
    near = cells_to.join(split, _same("source", "s")).filter((F.col("n_to") > F.col("n_from") - AROUND) & (F.col("n_to") - F.col("n") < F.col("n_until") + AROUND))
    near = stored(near.select(F.col("source").alias("s"), F.col("cell").alias("c"), "more", (F.col("size_to") - F.col("size")).alias("before")), "near")
    inside = rows.join(near.select("s", "c"), _same("source", "s") & (F.col("cell") == F.col("c"))).groupBy("source", "mark").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    inside = inside.join(near.groupBy("s").agg(F.min("before").alias("base"), F.first("more").alias("more")), _same("source", "s")).drop("s")
    whole, in_order = Window.partitionBy("source"), Window.partitionBy("source").orderBy("mark")
    inside = inside.withColumns({"to": F.sum(F.col("size") * F.col("n")).over(in_order) + F.col("base"), "k": F.sum("n").over(in_order)})
    start = F.col("k") - F.col("n")
    passed = F.when(F.col("to") > F.col("more"), start + F.floor((F.col("more") - F.col("to") + F.col("size") * F.col("n")) / F.col("size")))
    inside = inside.withColumns({"total": F.max("k").over(whole), "cut": F.coalesce(F.min(passed).over(whole), F.max("k").over(whole))})
    inside = inside.withColumn("high", F.least("total", F.greatest(F.col("cut") - AROUND // 2, F.lit(0)) + AROUND)).withColumn("low", F.greatest(F.col("high") - AROUND, F.lit(0)))
    inside = inside.withColumns({"fixed": F.greatest(F.lit(0), F.least("k", "low") - start), "near": F.greatest(F.lit(0), F.least("k", "high") - F.greatest(start, F.col("low")))})
    group = F.when(F.col("near") > 0, F.struct("mark", "size", "n", "fixed", F.col("near").cast("int").alias("near")))
    found = inside.groupBy("source", "more").agg((F.max("base") + F.sum(F.col("size") * F.col("fixed"))).alias("base"), F.array_sort(F.collect_list(group)).alias("groups"))
    found = stored(found.select("source", "more", "base", F.element_at("groups", 1).mark.alias("below"), F.element_at("groups", -1).mark.alias("above"), "groups"), "about")
    discard(cells, near)
    return found


def _chosen(about: DataFrame, under: bool = False) -> DataFrame:
    """(source, below, above, picks, parts, left): of each source's `groups` the subset whose sum is
    nearest, or (`under`) of those not above what is needed; `picks` are marks of groups taken whole, `parts` (mark, take, n) of those taken in part,
    `left` is what is still missing (or, below 0, too much)."""
    items = F.flatten(F.transform("groups", lambda g: F.array_repeat(F.struct(g.mark, g.size), g.near)))
    # The sum of subset i: bit k of i says whether item k is in it.
    sums = F.aggregate("items", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.transform(acc, lambda a: a + x["size"])))
    room = F.col("more") - F.col("base")
    best = F.array_min(F.transform("sums", lambda s, i: F.struct(F.when(s > room, F.lit(math.inf)).otherwise(room - s).alias("miss") if under else F.abs(s - room).alias("miss"), i.alias("subset"))))
    found = about.withColumn("items", items).withColumn("sums", sums).withColumn("subset", best["subset"])
    found = found.withColumn("left", room - F.element_at("sums", F.col("subset") + 1)).drop("sums")
    taken = F.filter("items", lambda x, i: F.getbit("subset", i) == 1)
    found = found.withColumn("taken", F.transform(taken, lambda x: x.mark))
    groups = F.transform("groups", lambda g: F.struct(g.mark.alias("mark"), (g.fixed + F.size(F.filter("taken", lambda m: m == g.mark))).alias("take"), g.n.alias("n")))
    found = found.withColumn("groups", groups)
    picks = F.transform(F.filter("groups", lambda g: g.take == g.n), lambda g: g.mark)
    parts = F.transform(F.filter("groups", lambda g: (g.take > 0) & (g.take < g.n)), lambda g: F.struct(g.mark.alias("mark"), g.take.alias("take"), g.n.alias("n")))
    return found.select("source", "below", "above", picks.alias("picks"), parts.alias("parts"), "left")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cyclic_weights, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(source, source_size, target, whole, but, below, above, small, below_small, picks, parts): all
    documents are taken `whole` times; once more those of a mark under `below`, those over `above`
    of at most `small` words and a mark under `below_small`, and those of the marks `picks` (if
    `but`, all others instead); of equal rows of the marks in `parts` so many of them."""
    rows = stored(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order_key(id_col, text_col, seed).alias("mark")), "rows")
    aims = targets(weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int")
    more = F.col("target") - F.col("whole") * F.col("source_size")
    aims = aims.withColumn("whole", whole).withColumn("more", more).withColumn("but", F.col("more") > F.col("source_size") / 2)
    aims = stored(aims.withColumn("more", F.when(F.col("but"), F.col("source_size") - F.col("more")).otherwise(F.col("more"))), "aims")
    about = _about_the_cut(rows.filter("size > 0"), aims.filter("more > 0").select("source", "more"))
    nearest = _chosen(about).select(F.col("source").alias("s1"), "below", "above", "picks", "parts", F.abs("left").alias("miss"))
    under = stored(_chosen(about, under=True).select(F.col("source").alias("s"), F.col("above").alias("over"), F.col("picks").alias("picks1"), F.col("parts").alias("parts1"), "left"), "under")
    rest = rows.join(under.select("s", "over", "left"), _same("source", "s")).filter((F.col("mark") > F.col("over")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
    about_rest = _about_the_cut(rest.select("source", "size", "mark"), under.filter("left > 0").select(F.col("s").alias("source"), F.col("left").alias("more")))
    fill = _chosen(about_rest).select(F.col("source").alias("s2"), F.col("below").alias("below_small"), F.col("picks").alias("picks2"), F.col("parts").alias("parts2"), F.abs("left").alias("miss2"))
    plan = aims.join(nearest, _same("source", "s1"), "left").join(under, _same("source", "s"), "left").join(fill, _same("source", "s2"), "left")
    filled = F.coalesce(F.col("miss2") < F.col("miss"), F.lit(False))
    either = lambda name: F.coalesce(F.when(filled, F.concat(f"{name}1", f"{name}2")).otherwise(F.col(name)), F.array())
    plan = plan.select("source", "source_size", "target", "whole", "but", "below", "above", F.when(filled, F.col("left")).alias("small"), "below_small", either("picks").alias("picks"), either("parts").alias("parts"))
    plan = plan.withColumn("parts", F.transform("parts", lambda x: F.struct(x.mark.alias("mark"), F.when(F.col("but"), x.n - x.take).otherwise(x.take).alias("take"))))
    plan = stored(plan, "plan")
    discard(rows, aims, about, under, about_rest)
    return plan


def _some_of_equal(out: DataFrame) -> DataFrame:
    """`out`, rows of marks that are taken in part, with column `again`: true for as many of the
    rows of a mark as its `take` says, counted partition by partition, so no mark meets in one task."""
    rows = stored(out.withColumn("place", F.spark_partition_id()), "copies")
    counts = rows.groupBy("s", "mark", "place", "take").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s", "mark").orderBy("place")) - F.col("n")
    quota = counts.select(F.col("s").alias("s_"), F.col("mark").alias("mark_"), F.col("place").alias("place_"), F.greatest(F.lit(0), F.col("take") - before).alias("quota"))
    found = rows.join(quota, _same("s", "s_") & (F.col("mark") == F.col("mark_")) & (F.col("place") == F.col("place_")))
    each = F.row_number().over(Window.partitionBy("s", "mark", "place").orderBy(F.xxhash64(*[c for c in out.columns if c.startswith("c")])))
    return found.withColumn("again", each <= F.col("quota")).select(*out.columns, "again")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """`docs` with a struct column `mix` (size, source_size, target, repeats) added, in place of a
    column of that name."""
    plan = mixing_plan(docs, id_col, text_col, source_col, seed=seed, **options).withColumnRenamed("source", "s")
    name = {c: f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col)}
    kept = numbered(docs).withColumns({"size": n_words(F.col(name[text_col])), "mark": order_key(name[id_col], name[text_col], seed)})
    out = kept.join(plan, F.col(name[source_col]).eqNullSafe(F.col("s")))
    small = (F.col("mark") > F.col("above")) & (F.col("size") <= F.col("small")) & (F.col("mark") < F.col("below_small"))
    again = F.coalesce((F.col("mark") < F.col("below")) | F.array_contains("picks", F.col("mark")) | small, F.lit(False)) != F.col("but")
    if plan.filter("size(parts) > 0").isEmpty():
        out = out.withColumn("again", again)
    else:
        out = out.withColumn("take", F.get(F.filter("parts", lambda x: x.mark == F.col("mark")), F.lit(0))["take"])
        out = out.filter("take is null").withColumn("again", again).unionByName(_some_of_equal(out.filter("take is not null")))
    return renamed(out, docs, mix=F.struct("size", "source_size", "target", (F.col("whole") + F.col("again").cast("int")).alias("repeats")))


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of `mixed` as often as the mix takes them, without its column."""
    times = F.explode(F.array_repeat(F.lit(1), F.col("mix.repeats")))
    return docs.withColumn("mix", times).drop("mix")
