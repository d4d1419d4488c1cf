"""Near-duplicate groups against all pairs of sets, in plain Python."""

import random
import re

import pandas as pd

from veloquy.llm import near_dup
from veloquy.llm.components import connected_components
from veloquy.llm.near_dup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    """Union-find over all pairs that share a shingle."""
    sets, by = {i: shingles(t) for i, t in rows}, {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = set()
    for ids in by.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(spark, rows, **kw):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, **kw).collect()}


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_large_groups_chains_and_a_shared_passage(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    passage, base, rows = [word() for _ in range(60)], [word() for _ in range(80)], []
    for i in range(150):  # near copies of one base, each with an own edit
        w = list(base)
        w[rnd.randrange(80)] = word()
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(30)])) for i in range(150)]  # one passage, no links
    chain = [word() for _ in range(100)]
    for i in range(12):  # neighbours linked, ends not
        rows.append((3000 + i, " ".join(chain)))
        chain = chain[12:] + [word() for _ in range(12)]
    rows += [(4000 + i, "same text five words long") for i in range(40)]
    assert result(spark, rows) == brute(rows)


def test_empty_null_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x " * 9), (7, "x " * 9), (8, "x " * 30)]
    df = spark.createDataFrame(pd.DataFrame([(*r, "c") for r in rows], columns=["doc_id", "text", "component"]).astype({"doc_id": "Int64"}), "doc_id long, text string, component string")
    df = df.unionByName(spark.createDataFrame([(None, "a b", None)], df.schema))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    touched = {i for e in edges if e[0] != e[1] for i in e}
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in touched} and len(got) == len(touched)


def test_texts_meet_their_classes_by_shuffle_too(spark, monkeypatch):
    """The join of texts and classes as it runs on large tables, where nothing is broadcast."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(30)]
    rows = [(i, base[i % 30] if i % 4 else base[i % 30] + f" x{i}") for i in range(240)] + [(999, None), (1000, "")]
    # With a filter of few bits, which lets others through, too.
    monkeypatch.setattr(near_dup, "FILTER_BITS", 128)
    some = spark.range(50).selectExpr("id as doc_id")
    passed = {r.doc_id for r in near_dup._possible(spark.range(5000).selectExpr("id as doc_id", "'t' as text"), some).collect()}
    assert set(range(50)) <= passed and 50 < len(passed) < 5000
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        got = result(spark, rows)
    finally:
        spark.conf.set(name, before)
    assert got == brute(rows) == result(spark, rows)
