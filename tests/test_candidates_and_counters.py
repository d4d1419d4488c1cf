"""Ids between known ones against a search by hand, and counters of one pass."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veloquy.functions import text as tx
from veloquy.operators import catalog

DAY = datetime.date(2026, 1, 1)


def by_hand(known, days, radius):
    out = []
    for day in days:
        if not known or day > max(d for _, d in known):
            continue
        low = max(((d, s) for s, d in known if d < day), default=None)
        high = min(((d, s) for s, d in known if d > day), default=None)
        own = min((s for s, d in known if d == day), default=None)
        if own is not None:
            seed = own
        elif low and high:
            seed = low[1] + max(1, int((high[1] - low[1]) * ((day - low[0]).days / max(1, (high[0] - low[0]).days))))
            seed = min(max(seed, low[1] + 1), high[1] - 1)
        elif low:
            seed = low[1] + max(1, (day - low[0]).days * 4)
        else:
            seed = max(1, high[1] - max(1, (high[0] - day).days * 4))
        first, last = low[1] + 1 if low else 1, high[1] - 1 if high else max(s for s, _ in known)
        order = [seed] + [s for r in range(1, radius + 1) for s in (seed + r, seed - r)]
        free = [s for s in order if first <= s <= last and s not in {k for k, _ in known}]
        out += [(day, i + 1, s) for i, s in enumerate(free)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_candidates_of_a_sparse_table(spark, seed):
    rnd = random.Random(seed)
    known = [(s, DAY + datetime.timedelta(days=s // 9 + 5)) for s in range(1, 600) if rnd.random() < 0.06]
    known += [(known[3][0] + 1, known[3][1])]
    days = [DAY + datetime.timedelta(days=i) for i in range(0, 80, 2)]
    df = spark.createDataFrame(known, "sid long, date date")
    got = catalog.id_candidates(df, spark.createDataFrame([(d,) for d in days], "day date"), 7)
    assert sorted((r.day, r["rank"], r.sid) for r in got.collect()) == by_hand(known, days, 7)
    assert catalog.id_candidates(df.limit(0), spark.createDataFrame([(DAY,)], "day date")).count() == 0


def test_counters_come_with_the_pass_that_writes(spark, tmp_path):
    rows = [(1, "plain"), (2, "ab" * 300), (3, "x" + "ゴ" * 15 + "y"), (4, "ご視聴ありがとうございました"), (5, "wrong word"), (6, None), (7, "")]
    cues = spark.createDataFrame(rows, "i int, text string")
    got = catalog.cleaned(cues, "text", {"wrong": "right"}, str(tmp_path / "out"))
    assert got == {"rows": 7, "loops": 2, "invented": 1, "glossary": 1}
    kept = {r.i: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kept == {1: "plain", 2: tx.UNCLEAR, 3: f"x{tx.UNCLEAR}y", 5: "right word", 6: None, 7: ""}
    cues.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    changed = {"loops": tx.is_loop(F.col("text")), "missing": F.col("text").isNull()}
    seen, counters = catalog.observed(stored, "one", **changed)
    plan = seen._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    seen.write.parquet(str(tmp_path / "again"))
    want = catalog.changes(stored, **changed).first().asDict()
    assert counters.get == {"rows": 7, **want}
