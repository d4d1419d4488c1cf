"""The range-partitioned as-of join against the one by groups."""

import random

import pytest
from pyspark.sql import functions as F

from veloquy.operators import attribution as at


@pytest.fixture(scope="module")
def meetings(spark):
    """One meeting has 90 % of all cues; others have few, no speakers, late speakers, equal starts."""
    rnd = random.Random(4)
    cues = [(i, "big" if i % 10 else rnd.choice(["a", "b", "none", None]), rnd.choice([rnd.randrange(5000) / 2, None if i % 97 == 0 else 7.0])) for i in range(6000)]
    speakers = [(100 + i, "big", 20.0 + 13 * i) for i in range(120)] + [(300, "a", 500.0), (301, "a", 500.0), (302, "b", 1.0), (303, None, 900.0), (304, "late", 3.0)]
    return spark.createDataFrame(cues, "cue int, meeting string, ts double"), spark.createDataFrame(speakers, "speaker int, meeting string, ts double")


def plain(cues, speakers, clamp):
    out = []
    for c in cues:
        own = sorted((s.ts, s.speaker) for s in speakers if s.meeting == c.meeting)
        before = [s for t, s in own if c.ts is not None and t <= c.ts]
        out.append((c.cue, before[-1] if before else own[0][1] if own and clamp else None))
    return sorted(out)


@pytest.mark.parametrize("clamp", [True, False])
def test_ranges_find_what_groups_find(spark, meetings, clamp):
    cues, speakers = meetings
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = at.as_of_ranges(cues, speakers, "meeting", "ts", ["speaker"], clamp, tie="speaker").cache()
        assert sorted((r.cue, r.speaker) for r in got.collect()) == plain(cues.collect(), speakers.collect(), clamp)
        # No task of the local look-up has had more than its range of the large meeting.
        dealt = at._both_sides(cues, speakers, "meeting", "ts", ["speaker"], None).repartitionByRange("__by", "__at").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in dealt.filter("__by = 'big'").groupBy("p").count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got.columns == ["cue", "meeting", "ts", "speaker"]


def test_empty_sides(spark, meetings):
    cues, speakers = meetings
    assert at.as_of_ranges(cues.limit(0), speakers, "meeting", "ts", ["speaker"]).count() == 0
    assert at.as_of_ranges(cues, speakers.limit(0), "meeting", "ts", ["speaker"]).filter("speaker is not null").count() == 0
