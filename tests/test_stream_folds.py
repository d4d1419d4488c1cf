"""Streams of cues, cut into micro-batches at random, against the folds over whole meetings."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veloquy.operators import attribution as at
from veloquy.streaming import folds

KIND = "meeting string, ord long, start double, end double, text string, arrived timestamp, last boolean"
DAY = datetime.datetime(2026, 5, 1, tzinfo=datetime.UTC)


def meetings(rnd, n=4):
    """Rolling captions and pieces of sentences; some repeat, overlap, or are swallowed whole."""
    out = {}
    for m in range(n):
        said, cues = "", []
        for i in range(rnd.randrange(5, 30)):
            said += rnd.choice(["予算について伺います。", "お答えし", "ます。", "ありがとうございました", "、それでは次に", "abc def "])
            text = rnd.choice([said[-rnd.randrange(4, 30) :], said[-12:], cues[-1][3] if cues else said])
            cues.append((i, float(i // 2 if m == 1 else i), i + 1.5, text))
        out[f"m{m}"] = cues
    return out


def streamed(spark, tmp_path, stream, batches):
    """Rows of `stream` over micro-batches, one file each."""
    folder, out = tmp_path / "in", tmp_path / "out"
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        at = folder / f"{i:03d}.json"
        at.write_text("".join(json.dumps(dict(zip([f.split(" ")[0] for f in KIND.split(", ")], r, strict=True))) + "\n" for r in rows))
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    folds.rocksdb(spark)
    cues = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(folder))
    query = stream(cues).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(out))
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive
    return sorted((r.meeting, r.start, r.end, r.text) for r in spark.read.schema("meeting string, start double, end double, text string").parquet(str(out)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_whole_fold(spark, tmp_path, seed):
    rnd = random.Random(seed)
    known = meetings(rnd)
    rows = [(m, *c, (DAY + datetime.timedelta(seconds=c[0])).isoformat(), i == len(cues) - 1 and m != "m0") for m, cues in known.items() for i, c in enumerate(cues)]
    rows.sort(key=lambda r: (r[1], r[0]))
    batches, at_ = [], 0
    while at_ < len(rows):
        n = rnd.choice([1, 5, 30])
        part = rows[at_ : at_ + n]
        rnd.shuffle(part)
        batches.append(part)
        at_ += n
    # m0 has no end: a later arrival elsewhere moves the watermark past its timer.
    batches.append([("zz", 0, 0.0, 1.0, None, (DAY + datetime.timedelta(days=2)).isoformat(), True)])
    fold, stream = [(at.without_rolling, folds.rolling_stream), (at.merged_sentences, folds.sentence_stream)][seed - 1]
    whole = spark.createDataFrame([(m, [c[1:] for c in cues]) for m, cues in known.items()], "meeting string, cues array<struct<start: double, end: double, text: string>>")
    want = sorted((r.meeting, r.c.start, r.c.end, r.c.text) for r in whole.select("meeting", F.explode(fold(F.col("cues"))).alias("c")).collect())
    assert streamed(spark, tmp_path, stream, batches) == want
