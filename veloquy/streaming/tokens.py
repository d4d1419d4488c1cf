"""An incrementally kept token table, and cue ingestion as a stream.

Spark's own file source sees new files but not files changed in place. The token table can be
refreshed as a batch: rows whose (path, modification time, tokenizer version) are known are kept,
others are tokenised, rows of vanished files are dropped. Or it follows a stream of changes
(`sources.files`): of each batch only the folders of the files that it names are written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquy.functions.text import regex_tokens
from veloquy.operators.versions import VersionedTable
from veloquy.sources.captions import caption_cues
from veloquy.sources.files import FilesSource

KEY = ["path", "mtime", "version"]


def stale(files: DataFrame, table: DataFrame | None, version: str) -> tuple[DataFrame, DataFrame | None]:
    """(files to tokenise, rows of the table to keep)."""
    wanted = files.withColumn("version", F.lit(version))
    if table is None:
        return wanted, None
    return wanted.join(table.select(*KEY).distinct(), KEY, "left_anti"), table.join(wanted.select(*KEY).distinct(), KEY, "left_semi")


def refreshed(files: DataFrame, table: DataFrame | None, version: str = "1", tokenizer: Callable[[Column], Column] = regex_tokens) -> DataFrame:
    """The token table (path, mtime, version, cue_idx, start, end, text, tokens) for `files`
    (path, mtime, cues). With no table, or after a change of version, all of it is made anew."""
    todo, kept = stale(files, table, version)
    made = todo.select(*KEY, F.posexplode("cues").alias("cue_idx", "cue")).select(*KEY, "cue_idx", "cue.*")
    made = made.withColumn("tokens", tokenizer(F.col("text")))
    return made if kept is None else kept.select(*made.columns).unionByName(made)


def changed(files: DataFrame, table: DataFrame, version: str = "1") -> bool:
    """Whether a refresh would change the table."""
    todo, _ = stale(files, table, version)
    gone = table.select("path").distinct().join(files.select("path"), "path", "left_anti")
    return bool(todo.limit(1).count() or gone.limit(1).count())


def caption_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of caption files as they arrive: (path, cue_idx, start, end, text)."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.vtt").load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(caption_cues(F.col("value"))).alias("cue_idx", "cue"))
    return rows.select("path", "cue_idx", "cue.*")


def write_stream(cues: DataFrame, out: str, checkpoint: str):
    """Append to a Parquet table whatever is there now, exactly once."""
    return cues.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def follow(spark: SparkSession, folder: str, table: VersionedTable, listings: str, checkpoint: str, version: str = "1", tokenizer: Callable[[Column], Column] = regex_tokens):
    """Bring a token table (key `path`; columns as `refreshed` has them) to the caption files that are
    now in `folder`, by one stream over what was added, changed and taken away since it last ran.
    A batch that is run again after a crash replaces the same files by the same rows."""
    spark.dataSource.register(FilesSource)
    changes = spark.readStream.format("changed_files").option("suffix", ".vtt").option("listings", listings).load(folder)

    def apply(batch: DataFrame, _: int) -> None:
        put = batch.filter("change = 'put'").select("path", "mtime", F.lit(version).alias("version"), F.posexplode(caption_cues(F.col("content"))).alias("cue_idx", "cue"))
        made = put.select(*KEY, "cue_idx", "cue.*").withColumn("tokens", tokenizer(F.col("text")))
        table.replace(made, batch.select("path"))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
