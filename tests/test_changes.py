"""Files that change as a stream, tables in versions, and late speakers."""

import os

import pytest
from pyspark.sql import functions as F

from veloquy.operators import versions
from veloquy.operators.versions import VersionedTable
from veloquy.sources import files
from veloquy.sources.captions import caption_cues
from veloquy.streaming import tokens


def put(folder, name, texts, mtime):
    at = folder / name
    at.write_text("WEBVTT\n\n" + "\n".join(f"00:00:{i:02d}.000 --> 00:00:{i + 1:02d}.000\n{t}\n" for i, t in enumerate(texts)))
    os.utime(at, (mtime, mtime))


def run(spark, tmp_path, table):
    query = tokens.follow(spark, str(tmp_path / "in"), table, str(tmp_path / "listings"), str(tmp_path / "check"))
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


def whole(spark, folder):
    """The table made by a refresh of all files."""
    found = spark.read.format("changed_files").option("suffix", ".vtt").load(str(folder))
    assert {r.change for r in found.select("change").distinct().collect()} <= {"put"}
    return tokens.refreshed(found.select("path", "mtime", caption_cues(F.col("content")).alias("cues")), None)


def rows(df):
    return sorted((os.path.basename(r.path), r.mtime, r.version, r.cue_idx, r.start, r.end, r.text, tuple(r.tokens)) for r in df.collect())


def test_a_stream_over_changes_equals_a_refresh(spark, tmp_path):
    spark.dataSource.register(files.FilesSource)
    folder = tmp_path / "in"
    os.makedirs(folder)
    table = VersionedTable(spark, str(tmp_path / "table"), "path", 4)
    for i in range(7):
        put(folder, f"f{i}.vtt", [f"hello file {i}", "two"], 1_700_000_000 + i)
    (folder / "other.txt").write_text("no captions")
    run(spark, tmp_path, table)
    first = table.read()
    assert rows(first) == rows(whole(spark, folder)) and len(rows(first)) == 14
    old = rows(first)
    put(folder, "f1.vtt", ["changed in place"], 1_700_000_500)
    put(folder, "f9.vtt", ["new"], 1_700_000_501)
    os.remove(folder / "f3.vtt")
    run(spark, tmp_path, table)
    assert rows(table.read()) == rows(whole(spark, folder)) and len(rows(table.read())) == 12
    assert rows(table.read(1)) == old
    run(spark, tmp_path, table)
    assert table.versions() == [1, 2]  # nothing has changed
    put(folder, "f9.vtt", [], 1_700_000_502)
    run(spark, tmp_path, table)
    assert rows(table.read()) == rows(whole(spark, folder))
    for name in os.listdir(folder):
        os.remove(folder / name)
    run(spark, tmp_path, table)
    assert table.read().count() == 0


def test_differences_of_listings():
    assert files.differences({"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 2, "d": 5}) == [("b", 2, "put"), ("c", 1, "gone"), ("d", 5, "put")]
    assert files.differences({}, {}) == []


SPEAKERS = "meeting string, stamp int, speakers array<struct<ts: double, speaker: string>>"


def test_late_speakers_touch_their_meetings_only(spark, tmp_path, monkeypatch):
    cues = spark.createDataFrame([(f"m{m}", float(t), f"{m}-{t}") for m in range(12) for t in range(6)], "meeting string, ts double, text string")
    read = lambda keys: cues.join(keys, "meeting", "left_semi")
    table = VersionedTable(spark, str(tmp_path / "table"), "meeting", 8)
    first = spark.createDataFrame([(f"m{m}", 1, [] if m % 4 == 0 else [(1.0, "a"), (3.0, "b")]) for m in range(12)], SPEAKERS)
    refresh = lambda now, known: versions.refreshed_attribution(table, now, known, read, "ts", ["speaker"])
    assert refresh(first, None) == 1
    state = lambda: {(r.meeting, r.ts): r.speaker for r in table.read().collect()}
    before = state()
    assert len(before) == 72 and before["m0", 5.0] is None and before["m1", 0.0] is None and before["m1", 2.0] == "a" and before["m1", 5.0] == "b"
    # Speakers of m4 come late, m1's change, m7 goes.
    now = first.filter("meeting <> 'm7'").withColumn("speakers", F.when(F.col("meeting").isin("m4", "m1"), F.expr("array(named_struct('ts', 2D, 'speaker', 'late'))")).otherwise(F.col("speakers"))).withColumn("stamp", F.when(F.col("meeting").isin("m4", "m1"), 2).otherwise(1))
    want = {k: v for k, v in before.items() if k[0] != "m7"} | {(m, float(t)): "late" if t >= 2 else None for m in ("m4", "m1") for t in range(6)}
    known = first.select("meeting", "stamp")
    for step in ("stored", "as_of_ranges", "_folders", "_commit"):
        with monkeypatch.context() as m:

            def stop(*a, **kw):
                raise RuntimeError(step)

            m.setattr(versions if hasattr(versions, step) else VersionedTable, step, stop)
            with pytest.raises(RuntimeError, match=step):
                refresh(now, known)
        assert table.versions() == [1] and state() == before
    files_before = {str(f.relative_to(tmp_path)) for f in (tmp_path / "table" / "data").rglob("*.parquet")}
    assert refresh(now, known) == 2 and state() == want
    kept = {v for v in table._manifest()[1].values()}
    assert kept == {1, 2} and {str(f.relative_to(tmp_path)) for f in (tmp_path / "table" / "data" / "version=1").rglob("*.parquet")} <= files_before
    assert refresh(now, now.select("meeting", "stamp")) == 2
    table.vacuum()
    assert state() == want and table.versions() == [2]
