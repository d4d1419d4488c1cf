"""The document pipeline: rules, near duplicates, pseudonyms, mixing, pieces.

Each stage takes (spark, docs, sf_dir) with `docs` as its predecessor wrote them and returns a
DataFrame; all but the last return the columns of the documents table, whatever other columns
there are. Defined results: null and empty texts have no words, so the rules reject them; a
stage that gets such rows all the same passes them on (near duplicates keep them, pseudonyms leave
them, the mix counts them as size 0, pieces are null or empty). Texts of any length are worked on
whole. Of rows that repeat an id and its text one stays; other rows of one id stay unless all of
them are near duplicates of smaller ids; rows without id are compared with nothing and stay. Ties
between near duplicates go to the least id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquy.llm import registry
from veloquy.llm.common import documents, stored
from veloquy.llm.mixing import mixed, repeated
from veloquy.llm.near_dup import near_duplicates
from veloquy.llm.pieces import with_pieces
from veloquy.llm.pii import pseudonymised
from veloquy.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    found = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("doc_id").alias("rows"))
    found = stored(found.filter("not kept or rows > 1"), "found")
    left = docs.select(*COLUMNS).join(found.filter("not kept").select("doc_id"), "doc_id", "left_anti")
    again = found.filter("kept").select("doc_id")
    if not again.isEmpty():
        once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(again, "doc_id", "left_anti").unionByName(once)
    return left.select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the new text."""
    return pseudonymised(docs.select(*COLUMNS), registry.PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeated(mixed(docs.select(*COLUMNS))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    found = with_pieces(docs.select(*COLUMNS), registry.piece_model(spark))
    return found.select("doc_id", "source", "lang", F.size("pieces").alias("n_pieces"), "pieces")


STAGES = [("quality rules", quality_stage), ("near duplicates", near_dup_stage), ("pseudonyms", pii_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
