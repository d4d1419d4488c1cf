"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of one label that a model is fitted on, most characters of all of them, and the
#: longest text among them, so that no single draw outgrows the driver.
ROWS_A_LABEL = 2000
SAMPLE_CHARS = 8_000_000
LONGEST = 400_000


def _drawn(id_col: str, label_col: str, rates: dict, seed: int) -> Column:
    """True for the rate's share of each label's rows, by a hash of the id."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for label, rate in rates.items():
        wanted = wanted | ((F.col(label_col) == F.lit(label)) & (draw < F.lit(rate)))
    return wanted


def labelled_sample(rows: DataFrame, id_col: str, text_col: str, label_col: str, rows_a_label: int = ROWS_A_LABEL, most_chars: int = SAMPLE_CHARS, seed: int = 11) -> pd.DataFrame:
    """(text, label) of about `rows_a_label` rows of each label, chosen by a hash of the id.

    Rows without label or text, and texts of more than LONGEST characters, are not drawn. The
    sample's bound holds whatever the input's size: labels with fewer rows are taken whole, others
    at the rate that gives the bound. Without rows the sample is empty.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull() & (F.length("text") <= LONGEST))
    size = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean")).collect()
    if not size:
        return pd.DataFrame({"text": pd.Series(dtype=str), "label": pd.Series(dtype=object)})
    chars = sum(min(r.n, rows_a_label) * r["mean"] for r in size)
    shrink = min(1.0, most_chars / max(chars, 1.0))
    found = rows.filter(_drawn("id", "label", {r.label: shrink * rows_a_label / r.n for r in size}, seed)).select("id", "text", "label").toArrow().to_pandas()
    return found.sort_values(["label", "id", "text"], ignore_index=True)[["text", "label"]]


def joined_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_a_label: int = ROWS_A_LABEL, most_chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """As `labelled_sample`, with labels in a table of their own. Ids are drawn from it first, so
    only about `rows_a_label` rows of each label are broadcast and no text is shuffled."""
    known = labels.filter(F.col(label_col).isNotNull())
    rates = {r[label_col]: rows_a_label / r["count"] for r in known.groupBy(label_col).count().collect()}
    ids = known.filter(_drawn(id_col, label_col, rates, 12)).select(id_col, label_col)
    return labelled_sample(docs.select(id_col, text_col).join(F.broadcast(ids), id_col), id_col, text_col, label_col, rows_a_label, most_chars)


def label_share(rows: DataFrame, label_col: str) -> float | None:
    """Share of label 1 among labelled rows; None without any."""
    return rows.filter(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
