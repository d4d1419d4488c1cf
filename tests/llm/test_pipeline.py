"""The pipeline's stages against plain versions of their decisions."""

import re

import corpus_pipeline as cp
from test_near_dup import brute as brute_groups
from test_document_operators import brute_rules
from veloquy.llm import quality_rules

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    done = [docs]
    for _, stage in cp.STAGES:
        done.append(stage(spark, done[-1], SMALL).cache())
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in done]

    def keeps(t):
        m = brute_rules(t)
        ok = m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"]
        ok &= all(m[f"dup_chars_{n}"] <= limit * m["word_chars"] for n, limit in quality_rules.COVERAGE_LIMITS.items())
        return ok and m["dup_line_chars"] <= quality_rules.LINE_LIMIT * m["line_chars"] and m["n_symbols"] <= quality_rules.SYMBOL_LIMIT * m["word_chars"]

    assert sorted(ids[1]) == sorted(i for i, t in text.items() if keeps(t))
    groups = brute_groups([(i, text[i]) for i in ids[1]])
    assert sorted(ids[2]) == sorted(i for i, (_, root) in groups.items() if i == root)
    assert sorted(ids[3]) == sorted(ids[2])
    mail = re.compile(r"\w+\.\d\d@mail\d\.example\.com")
    old = {m for i in ids[2] for m in mail.findall(text[i])}
    assert not any(m in r.text for r in done[3].collect() for m in old)
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= 3
    assert sorted(ids[5]) == sorted(ids[4])
    assert all(d.columns == cp.COLUMNS for d in done[1:5]) and min(r.n_pieces for r in done[5].collect()) > 0


def test_odd_rows(spark):
    long = " ".join(f"w{i * i % 9973}x{i}" for i in range(120_000))
    twin = "Eleven plain words of one text that two rows share in full."
    rows = [
        (1, None, "en", "a", None, "x"), (2, "", None, None, 0, "x"), (3, long, "en", "a", 1, "x"), (4, long, "en", "b", 1, "x"), (5, twin, "en", "b", 1, "x"), (5, twin, "en", "b", 1, "x"),
        (6, twin + " Or not quite.", "en", None, 1, "x"), (None, "Some words without an id that no other row has, and then a few more of them.", "en", "a", 1, "x"),
        (7, "Call 555-123-4567 or write to jo.smith@mail.example.com about the eleven other words here.", "en", "a", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix string")
    assert len(long) > 1_000_000
    done = [docs]
    for _, stage in cp.STAGES:
        done.append(stage(spark, done[-1], SMALL).cache())
    ids = [sorted(r.doc_id or 0 for r in d.select("doc_id").collect()) for d in done]
    assert ids[1] == [0, 3, 4, 5, 5, 6, 7] and ids[2] == ids[3] == [0, 3, 5, 6, 7]
    changed = {r.doc_id: r.text for r in done[3].collect()}
    assert changed[3] == long and "555-123-4567" not in changed[7] and "jo.smith" not in changed[7] and changed[7].endswith("other words here.")
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4] and done[5].filter("n_pieces < 10").count() == 0
    step = docs.limit(0)
    for _, stage in cp.STAGES:
        step = stage(spark, step, SMALL)
        assert step.count() == 0
