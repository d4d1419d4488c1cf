"""A Column function on values of its own, for tests of text functions and readers."""

from pyspark.sql import functions as F

from veloquy.sources import captions

SPEAKERS = captions.SPEAKERS


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def many(spark, column, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", column(F.col("v")).alias("x"))
    return [r.x for r in sorted(rows.collect(), key=lambda r: r.i)]
