"""What the operators of this subpackage share: tables, keys and shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquy.session import BATCH_ROWS as BATCH_ROWS
from veloquy.session import small_batches as small_batches
from veloquy.storage import discard as discard
from veloquy.storage import shared_dir as shared_dir
from veloquy.storage import stored as stored

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod, F.lit(0).cast("long"))


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with columns c0, c1, ..., which no name that an operator uses can clash with."""
    return small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])


def renamed(out: DataFrame, docs: DataFrame, **added: Column | str) -> DataFrame:
    """`out`, made from `numbered(docs)`, with the names of `docs` again and the columns `added`,
    each in place of a column of its name that `docs` may have, as withColumn does."""
    new = {name.lower() for name in added}
    old = [F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns) if name.lower() not in new]
    return out.select(*old, *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in added.items()])
