"""Folds over the cues of meetings as streams: rolling captions undone, sentences merged.

The folds of `attribution` look at what was kept last only, so a stream needs one cue of each
meeting as its state. Cues come with the time at which they arrived; from one micro-batch to the
next they come in order of start, within one in any order. What a fold holds is given out when the
next cue shows that it is complete, and when the meeting ends: at a row whose `last` is true, or
by a timer, once the watermark is `idle` seconds past the meeting's last arrival. However a
meeting is cut into micro-batches, the rows are those of the fold over the whole meeting.

Queries need the state store of the `rocksdb` setting below. Defined results: rows without text
(null) only carry time and the end; a meeting that goes on after its end or its timer starts anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veloquy.functions.text import SENTENCE_ENDS, punctuated

CUE = "start double, end double, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENDS = re.compile("(?:" + "|".join(SENTENCE_ENDS) + ")[。！？]?$")
_LEAD = re.compile("^[ 、。,.]+")
Cue = tuple[float, float, str]


def rolled(last: Cue | None, cue: Cue, longest: int = 200, least: int = 6) -> tuple[list[Cue], Cue | None]:
    """(cues that are complete, cue to hold) of one step of `attribution.without_rolling`."""
    if last is None:
        return [], cue
    if last[2] == cue[2]:
        return [], (last[0], cue[1], last[2])
    most = min(len(last[2]), len(cue[2]), longest)
    cut = next((n for n in range(most, least - 1, -1) if last[2].endswith(cue[2][:n])), 0)
    rest = _LEAD.sub("", cue[2][cut:]) if cut else cue[2]
    return ([], last) if rest == "" else ([last], (cue[0], cue[1], rest))


def joined(last: Cue | None, cue: Cue) -> tuple[list[Cue], Cue | None]:
    """The same of `attribution.merged_sentences`, before punctuation."""
    if last is None:
        return [], cue
    if _ENDS.search(last[2].replace(" ", "").replace("\t", "")):
        return [last], cue
    return [], (last[0], cue[1], last[2] + cue[2])


class _Fold(StatefulProcessor):
    """State: the cue held of each meeting, and the timer that will end it."""

    def __init__(self, step, idle: float) -> None:
        self.step, self.idle = step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", CUE)

    def _given(self, key: tuple, cues: list[Cue]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in cues], columns=["meeting", "start", "end", "text"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["start", "ord"], kind="stable", na_position="last")  # one micro-batch of a meeting
        held = self.held.get() if self.held.exists() else None
        held, done = tuple(held) if held is not None else None, []
        for start, end, text in zip(batch["start"], batch["end"], batch["text"], strict=True):
            if isinstance(text, str):
                given, held = self.step(held, (float(start), float(end), text))
                done += given
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if batch["last"].fillna(False).astype(bool).any():
            done += [held] if held is not None else []
            held = None
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(int(batch["arrived"].max().timestamp() * 1000 + self.idle * 1000))
        yield self._given(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = [tuple(self.held.get())] if self.held.exists() else []
        self.held.clear()
        yield self._given(key, done)

    def close(self) -> None:
        pass


def rocksdb(spark: SparkSession) -> None:
    """The state store that the folds need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _folded(cues: DataFrame, step, idle: float, delay: str) -> DataFrame:
    rows = cues.select("meeting", "start", "end", "text", F.col("ord").cast("long").alias("ord"), "arrived", "last").withWatermark("arrived", delay)
    return rows.groupBy("meeting").transformWithStateInPandas(_Fold(step, idle), f"meeting string, {CUE}", "Append", "EventTime")


def rolling_stream(cues: DataFrame, idle: float = 3600.0, delay: str = "0 seconds") -> DataFrame:
    """(meeting, start, end, text) without repeats, of a stream (meeting, ord, start, end, text,
    arrived, last); `ord` decides between cues of equal start."""
    return _folded(cues, rolled, idle, delay)


def sentence_stream(cues: DataFrame, idle: float = 3600.0, delay: str = "0 seconds") -> DataFrame:
    """The same with cues joined to sentences and punctuated."""
    return _folded(cues, joined, idle, delay).withColumn("text", punctuated(F.col("text")))
