"""Listings, status, priorities, drift, patches and small windows over tables of any size."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an explicit order. An order of plain columns is kept by partial
    sums, so a frequent key moves one row a task; other orders need a window over each key."""
    if order and all(isinstance(o, str) for o in order):
        rest = [c for c in rows.columns if c not in keys]
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(rest or keys)), F.struct(*order)).alias("__first"))
        return first.select(*[F.col(c) if c in keys else F.col(f"__first.`{c}`").alias(c) for c in rows.columns])
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_status(items: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """`items` with `fetched` true where any row of that table has its keys. Rows of blank keys have
    been fetched for nobody."""
    for key in keys:
        fetched = fetched.filter(F.btrim(F.col(key).cast("string")) != "")
    known = fetched.select(*keys).distinct().withColumn("fetched", F.lit(True))
    return items.join(known, keys, "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))


def only_new(items: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(fetched.select(*keys), keys, "left_anti")


def only_fetched(items: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(fetched.select(*keys).distinct(), keys, "left_semi")


def by_priority(tables: list[DataFrame], key: str, keep_all_of_first: bool = True) -> DataFrame:
    """Union of tables of one schema; a key that an earlier table has is left out of later ones.
    Repeats within the first table stay if asked; of other repeats the least row stays."""
    tagged = [t.withColumn("priority", F.lit(i)) for i, t in enumerate(tables)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    w = Window.partitionBy(key)
    rest = [F.col(c) for c in tables[0].columns if c != key]
    ranked = whole.withColumn("__least", F.min("priority").over(w)).withColumn("__n", F.row_number().over(w.orderBy("priority", *rest)))
    first = (F.col("priority") == 0) & F.lit(keep_all_of_first)
    return ranked.filter(first | ((F.col("__n") == 1) & (F.col("priority") == F.col("__least")))).drop("__least", "__n")


def drift(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys added and removed since: (key, change)."""
    a, b = now.select(key).distinct(), before.select(key).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("added")).unionByName(b.exceptAll(a).withColumn("change", F.lit("removed")))


def patched(rows: DataFrame, patches: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """`rows` with the last non-empty, differing patch of each key applied, and `changed`."""
    last = first_of(patches.filter(F.coalesce("new_text", F.lit("")) != ""), [key], F.desc(order)).select(key, "new_text")
    joined = rows.join(last, key, "left")
    changed = F.coalesce(F.col("new_text") != F.col(text), F.lit(False))
    return joined.withColumn("changed", changed).withColumn(text, F.coalesce("new_text", text)).drop("new_text")


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def batches(rows: DataFrame, by: str, order: str, size: int = 8, *tie: str) -> DataFrame:
    """`rows` with their place in order, by eights, from 0; rows of equal order by `tie`."""
    w = Window.partitionBy(by).orderBy(order, *tie)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def within_budget(rows: DataFrame, by: str, order: str, text: str, most: int, *tie: str) -> DataFrame:
    """The longest prefix of each group whose texts have at most `most` characters together; rows of
    equal order by `tie`."""
    w = Window.partitionBy(by).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.sum(F.length(text)).over(w).cast("long")).filter(F.col("so_far") <= most)


def calendar(spark, start: str, end: str, most_days: int = 60) -> DataFrame:
    """All days of a range, its ends in either order, cut to the last `most_days` days."""
    low, high = sorted((start, end))
    days = F.sequence(F.greatest(F.to_date(F.lit(low)), F.date_sub(F.to_date(F.lit(high)), most_days)), F.to_date(F.lit(high)))
    return spark.range(1).select(F.explode(days).alias("day"))


def listing_range(today: date, on: date | None = None, since: date | None = None, until: date | None = None, days: int = 7) -> tuple[date, date]:
    """First and last day of a listing: one day if `on` is given; else missing ends are `days`
    before today, and today."""
    if on is not None:
        return on, on
    return since or today - timedelta(days=days), until or today


def suggestions(items: DataFrame, query: str, k: int = 10, order: tuple[str, ...] = ("date", "house", "id")) -> DataFrame:
    """The first `k` items not fetched yet whose title has the first word of a query in it."""
    words = query.replace('"', "").split()
    rows = items.filter(~F.coalesce("fetched", F.lit(False)))
    if words:
        rows = rows.filter(F.col("title").contains(words[0]))
    return rows.orderBy(*order).limit(k)


def unfinished(items: DataFrame, files: DataFrame, keys: list[str], kinds: list[str], kind: str = "kind") -> DataFrame:
    """`items` that lack a file of one of `kinds`; `files` has a row (keys, kind) for each file."""
    whole = files.filter(F.col(kind).isin(kinds)).groupBy(*keys).agg(F.count_distinct(kind).alias("__n")).filter(F.col("__n") == len(set(kinds)))
    return items.join(whole.select(*keys), keys, "left_anti")


def resolved(items: DataFrame, key: str) -> DataFrame:
    """Items whose id is known."""
    return items.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")


def changes(rows: DataFrame, *by: str, **changed: Column) -> DataFrame:
    """How many rows each step changed: one sum of a condition for each name, by group if asked."""
    return rows.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name) for name, c in changed.items()])


def last_known(known: DataFrame, id_col: str = "sid", valid: str = "valid") -> DataFrame:
    """The greatest valid id, one row."""
    return known.filter(valid).agg(F.max(id_col).alias(id_col))


def ids_on(known: DataFrame, day: str, id_col: str = "sid", valid: str = "valid") -> DataFrame:
    """Valid ids of one day, in order."""
    return known.filter(F.col(valid) & (F.col("date") == day)).select(id_col, "name").orderBy(id_col)


def id_candidates(known: DataFrame, days: DataFrame, radius: int = 50, slope: int = 4, id_col: str = "sid") -> DataFrame:
    """(day, rank, sid): ids that may belong to each day of `days` (day), most likely first. `known`
    (id, date) are ids whose dates are known. Numbers grow with dates, so the nearest known ids on
    either side are found by two as-of joins, the id expected between them by interpolation (beyond
    the first: `slope` ids a day), or the least id known for the day itself; candidates are the ids
    not known yet at most `radius` from it between those neighbours (up to the greatest known),
    nearest first, the greater of two first. Days after the last known one have none."""
    from veloquy.operators.attribution import as_of_ranges

    ids = known.select(F.lit(0).alias("g"), F.col(id_col).cast("long").alias("sid"), F.col("date").cast("date").alias("date")).filter("sid is not null and date is not null")
    day = F.unix_date("date")
    asked = days.select(F.col("day").cast("date").alias("day")).filter("day is not null").distinct().withColumn("g", F.lit(0))
    low = ids.select("g", day.alias("at"), F.col("sid").alias("low"), F.col("date").alias("low_day"))
    high = ids.select("g", (-day).alias("at"), F.col("sid").alias("high"), F.col("date").alias("high_day"), (-F.col("sid")).alias("back"))
    both = as_of_ranges(asked.withColumn("at", F.unix_date("day") - 1), low, "g", "at", ["low", "low_day"], False, "low")
    both = as_of_ranges(both.withColumn("at", -F.unix_date("day") - 1), high, "g", "at", ["high", "high_day"], False, "back")
    own = ids.groupBy(F.col("date").alias("own_day")).agg(F.min("sid").alias("own"))
    last = ids.agg(F.max("sid").alias("last"), F.max("date").alias("last_day"))  # one row
    both = both.join(own, F.col("day") == F.col("own_day"), "left").crossJoin(last).filter("day <= last_day")
    span = F.greatest(F.lit(1), F.date_diff("high_day", "low_day"))
    between = F.col("low") + F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low")) * (F.date_diff("day", "low_day") / span)))
    between = F.least(F.greatest(between, F.col("low") + 1), F.col("high") - 1)
    after = F.col("low") + F.greatest(F.lit(1), F.date_diff("day", "low_day") * slope)
    before = F.greatest(F.lit(1), F.col("high") - F.greatest(F.lit(1), F.date_diff("high_day", "day") * slope))
    seed = F.coalesce(F.col("own"), F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), between).when(F.col("low").isNotNull(), after).otherwise(before))
    each = both.select("day", F.coalesce(F.col("low") + 1, F.lit(1)).alias("from"), F.coalesce(F.col("high") - 1, F.col("last")).alias("to"), seed.alias("seed"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("off"))
    each = each.withColumn("sid", F.col("seed") + F.col("off")).filter("sid between `from` and `to`").join(ids.select("sid"), "sid", "left_anti")
    nearest = Window.partitionBy("day").orderBy(F.abs("off"), F.desc("off"))  # 2 * radius + 1 rows at most
    return each.select("day", F.row_number().over(nearest).alias("rank"), "sid")


def observed(rows: DataFrame, name: str, **changed: Column) -> tuple[DataFrame, Observation]:
    """`rows`, and counters of the same kind as `changes` that are summed up in the very pass that
    writes or reads the rows; `.get` of the second has them afterwards, and `rows`, their number."""
    seen = Observation(name)
    sums = [F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in changed.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *sums), seen


def cleaned(cues: DataFrame, text: str, glossary: dict[str, str], path: str) -> dict[str, int]:
    """Write `cues` with `text` cleaned (loops out, glossary applied, invented phrases dropped) and
    return the counters of the run: rows, loops, invented, glossary. One pass over the cues."""
    from veloquy.functions.text import is_invented, is_loop, replaced, without_loops

    t = F.col(text)
    once = cues.withColumn("__plain", without_loops(t)).withColumn("__new", replaced(F.col("__plain"), glossary))
    seen, counters = observed(once, "cleaning", loops=is_loop(t) | (F.col("__plain") != t), invented=is_invented(F.col("__plain")), glossary=F.col("__new") != F.col("__plain"))
    kept = seen.filter(~F.coalesce(is_invented(F.col("__plain")), F.lit(False)))
    kept.withColumn(text, F.col("__new")).select(*cues.columns).write.mode("overwrite").parquet(path)
    return {n: int(v) for n, v in counters.get.items()}


def sid_pages(pages: DataFrame, id_col: str = "sid", html: str = "html", least: int = 500) -> DataFrame:
    """(sid, date, name, valid) of fetched pages; short pages and those without a date are not
    valid, and pages that could not be fetched (null) are not remembered at all."""
    from veloquy.functions.text import labelled_value, normal_date
    from veloquy.sources.pages import DATE_LABEL, TITLE_LABEL

    day = F.coalesce(normal_date(labelled_value(F.col(html), DATE_LABEL)), F.lit(""))
    rows = pages.filter(F.col(html).isNotNull()).select(id_col, day.alias("date"), F.coalesce(labelled_value(F.col(html), TITLE_LABEL), F.lit("")).alias("name"), F.length(html).alias("__n"))
    return rows.withColumn("valid", (F.col("__n") >= least) & (F.col("date") != "")).drop("__n")
