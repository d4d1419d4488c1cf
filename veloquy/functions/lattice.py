"""Tokens of scripts without spaces: the cheapest path through the words of a dictionary.

The dictionary is a table (surface, class, cost, and the form to search by); costs between classes
of neighbours are another. All words that begin at a place are found in one walk down a trie; for
each place and class the cheapest way to it is kept (Viterbi), and the path is read back from the
end. Where no word begins, the run of one script up to the next place where one does is an unknown
word, and so is its first character. Words of classes that mean nothing alone are dropped, as are single characters
that are no ideographs.

Without costs `learned_costs` takes them from texts: it segments all of them with what it has (at
first every word costs the same, so the fewest words win), counts the words in Spark and makes
costs of the counts, for some rounds. Each task builds the trie once; the dictionary has at most MOST_WORDS words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of words that are dropped.
DROPPED = ("助詞", "助動詞", "補助記号", "記号", "空白", "接続詞")
UNKNOWN = "未知"
#: Cost of an unknown word, and of each of its characters.
UNKNOWN_COST, UNKNOWN_CHAR = 12.0, 2.0
MOST_WORDS = 1_000_000
Word = tuple[str, str, float, str]  # surface, class, cost, form


def script(c: str) -> str:
    if "一" <= c <= "鿿" or c in "々〆":
        return "han"
    if "ぁ" <= c <= "ゖ":
        return "hiragana"
    if "ァ" <= c <= "ヺ" or c == "ー":
        return "katakana"
    return "space" if c.isspace() else "word" if c.isalnum() else "mark"


class Lattice:
    def __init__(self, words: list[Word], joins: dict[tuple[str, str], float] | None = None) -> None:
        self.joins, self.root = joins or {}, {}
        for word in words:
            node = self.root
            for c in word[0]:
                node = node.setdefault(c, {})
            if word[0]:
                node.setdefault("", []).append(word)

    def _known(self, text: str, at: int) -> list[Word]:
        """Words of the dictionary that begin at a place."""
        found, node = [], self.root
        while at < len(text) and (node := node.get(text[at])) is not None:
            found += node.get("", [])
            at += 1
        return found

    def words_at(self, text: str, at: int) -> list[Word]:
        """Words that may begin at a place, unknown ones where the dictionary has none."""
        found = self._known(text, at)
        if found:
            return found
        kind, stop = script(text[at]), at + 1
        while stop < len(text) and script(text[stop]) == kind and not self._known(text, stop):
            stop += 1
        cls = {"space": "空白", "mark": "記号"}.get(kind, UNKNOWN)
        return [(s, cls, UNKNOWN_COST + UNKNOWN_CHAR * len(s), s) for s in dict.fromkeys((text[at:stop], text[at]))]

    def path(self, text: str) -> list[Word]:
        """The words of the cheapest path; of equal ones that of the earlier found word."""
        best: list[dict[str, tuple[float, int, str, Word | None]]] = [{} for _ in range(len(text) + 1)]
        best[0][""] = (0.0, 0, "", None)
        for at in range(len(text)):
            if not best[at]:
                continue
            for word in self.words_at(text, at):
                cost, before = min((v[0] + self.joins.get((cls, word[1]), 0.0), cls) for cls, v in best[at].items())
                end, cost = at + len(word[0]), cost + word[2]
                held = best[end].get(word[1])
                if held is None or cost < held[0]:
                    best[end][word[1]] = (cost, at, before, word)
        out, at = [], len(text)
        cls = min(best[at], key=lambda c: best[at][c][0])
        while at:
            _, at, cls, word = best[at][cls]
            out.append(word)
        return out[::-1]

    def terms(self, text: str | None) -> list[str]:
        """What a text is searched by, lower-cased."""
        forms = [form for _, cls, _, form in self.path((text or "").lower()) if cls not in DROPPED and form]
        return [f for f in forms if len(f) > 1 or script(f) == "han"]


def read_dictionary(words: DataFrame, joins: DataFrame | None = None) -> tuple[list[Word], dict[tuple[str, str], float]]:
    """A dictionary (surface, cls, cost, form) and its joins (left, right, cost), on the driver."""
    kept = words.filter("surface <> ''").select("surface", "cls", F.col("cost").cast("double"), F.coalesce("form", "surface")).distinct().limit(MOST_WORDS + 1).collect()
    if len(kept) > MOST_WORDS:
        raise ValueError("the dictionary has more words than a task can hold")
    between = {} if joins is None else {(r[0], r[1]): r[2] for r in joins.select("left", "right", F.col("cost").cast("double")).collect()}  # pairs of classes
    return sorted(tuple(r) for r in kept), between


def with_terms(rows: DataFrame, text_col: str, words: list[Word], joins: dict | None = None, out: str = "tokens") -> DataFrame:
    """`rows` with the search terms of `text_col` as array<string>; null text has none. No shuffle."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(words, joins)
        for texts in parts:
            yield pd.Series([lattice.terms(t) for t in texts])

    return rows.withColumn(out, run(F.col(text_col)))


def learned_costs(texts: DataFrame, text_col: str, words: list[Word], rounds: int = 3) -> list[Word]:
    """`words` with costs by how often each is on the cheapest paths of all texts."""

    def counted(current: list[Word]) -> dict[tuple[str, str, str], int]:
        @F.pandas_udf("array<struct<surface: string, cls: string, form: string>>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lattice = Lattice(current)
            for some in parts:
                yield pd.Series([[{"surface": w[0], "cls": w[1], "form": w[3]} for w in lattice.path((t or "").lower())] for t in some])

        found = texts.select(F.explode(run(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        known = texts.sparkSession.createDataFrame([(w[0], w[1], w[3]) for w in current], "surface string, cls string, form string")
        kept = found.join(known, (F.col("w.surface") == F.col("surface")) & (F.col("w.cls") == F.col("cls")) & (F.col("w.form") == F.col("form")), "left_semi")
        return {(r.w.surface, r.w.cls, r.w.form): r.n for r in kept.collect()}  # a row a dictionary word at most

    current = [(s, c, 1.0, f) for s, c, _, f in words]
    for _ in range(rounds):
        n = counted(current)
        whole = sum(n.values()) + 0.5 * len(current)
        current = [(s, c, -math.log((n.get((s, c, f), 0) + 0.5) / whole), f) for s, c, _, f in current]
    return current
