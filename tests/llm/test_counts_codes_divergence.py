"""Token counts against the library, vector codes and divergence against plain Python, odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veloquy.llm import divergence as dv
from veloquy.llm import token_counts as tc
from veloquy.llm import vector_codes as vc

FILE = open("/opt/tokenizers/word_bpe_49k.json", "rb").read()
BITS = ["'re", "'s", "'ll", "'ve", "re", "a", "the", "s", "t", "é", "e", "́", "̀", " ", "  ", "\n", "　", "!", "'", "<|", "|>", "<|startoftext|>", "<|endoftext|>", ">", "̸", "İ", "ﬁ", "1", "٣", "½", "漢", "ก", "ำ", "한", "ᄀ", "ᅡ", "ᆨ", "😀", "‍", "Σ", "\0", "\x1c", "\x85", "<|startof", "Z", "internationalization", "ಾ", "ೆ"]


@pytest.fixture(scope="module")
def counter():
    return tc.parse_counter(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(FILE.decode())


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_of_the_documents_are_the_librarys(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in tc.with_budget(docs, FILE, 100).collect():
        assert r.tokens.n_tokens == n_tokens(library, r.text)
        assert n_tokens(library, r.text[: r.tokens.fits]) <= 100 and (r.tokens.fits == len(r.text) or n_tokens(library, r.text[: r.tokens.fits + 1]) > 100)


def test_every_prefix_has_the_librarys_count(counter, library):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(BITS, k=rnd.randrange(14))) for _ in range(400)] + ["don't they're", "aaaaaaaaaaaaaaaa", "<|startoftext|≯x"]
    for text, got in zip(texts, tc.prefix_counts(counter, texts), strict=True):
        assert got.tolist() == [n_tokens(library, text[:k]) for k in range(len(text) + 1)], repr(text)


def test_long_texts_are_worked_on_in_sections(counter, library, monkeypatch):
    monkeypatch.setattr(tc, "SECTION", 400)
    rnd = random.Random(12)
    long = " ".join("".join(rnd.choices("abcdefé'1", k=rnd.randrange(1, 12))) for _ in range(900))
    got = list(tc.prefix_counts(counter, [long, None, "", "one two", "x" * 3000]))
    assert [len(g) for g in got] == [len(long) + 1, 1, 1, 8, 3001]
    assert [int(g[-1]) for g in got] == [n_tokens(library, t) for t in (long, "", "", "one two", "x" * 3000)]
    assert [int(got[0][k]) for k in range(0, len(long), 97)] == [n_tokens(library, long[:k]) for k in range(0, len(long), 97)]


def test_stored_counts_answer_questions(spark, library):
    rows = spark.createDataFrame([(1, "Hello world, they're here", "clash"), (2, None, "clash"), (3, "", "clash"), (3, "", "clash")], "doc_id long, text string, made string")
    found = tc.with_prefix_counts(rows, FILE)
    assert found.columns == [*rows.columns, "prefix_tokens"]
    asked = found.select("doc_id", "text", *[tc.tokens_in(F.col("prefix_tokens"), F.lit(n)).alias(f"n{n}") for n in (-1, 0, 7, 99)], tc.longest_within(F.col("prefix_tokens"), F.lit(3)).alias("fits"))
    for r in asked.collect():
        text = r.text or ""
        assert [r["n-1"], r.n0, r.n7, r.n99] == [0, 0, n_tokens(library, text[:7]), n_tokens(library, text)]
        assert r.fits == max(k for k in range(len(text) + 1) if n_tokens(library, text[:k]) <= 3)
    assert tc.with_budget(rows.limit(0), FILE, 5).collect() == [] and found.count() == 4
    with pytest.raises(ValueError):
        tc.with_budget(rows, FILE, -1)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tc.parse_counter(open("/opt/tokenizers/byte_bpe_50k.json", "rb").read())


# ---- vector codes -----------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    """By all distances, in plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[near(books[p], cut(v, p))[1]].append(cut(v, p))
            for k, members in of.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, [near(books[p], cut(v, p)) for p in range(parts)], label) for i, v, label in kept]
    total = Counter()
    for _, n, label in found:
        total[label] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), total[label], sha) for i, n, label in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("seed", range(3))
def test_codes_are_those_of_all_distances(spark, seed):
    rnd = random.Random(seed)
    # Few distinct values: many ties, entries that are equal, entries that nothing is nearest to.
    rows = [(i * 7 % 97, [rnd.randrange(-3, 4) / (1 if seed else 8) for _ in range(8)], rnd.choice([1, 2, None])) for i in range(97)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [math.nan] * 8, 2), (203, [math.inf] + [0.0] * 7, None)]
    rows += [rows[3], rows[3], (rows[5][0], [9.0] * 8, 2), (None, [1.0] * 8, 2), (300, [], 1), (301, [2.0] * 3, None)]
    got = vc.compressed(vectors(spark, rows), parts=4, entries=6, rounds=3, scale=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, 4, 6, 3, 4)


def test_tree_search_is_the_search_over_all():
    rng = np.random.default_rng(3)
    for n, d, span in ((1, 3, 4), (16, 8, 2), (16, 2, 3), (256, 4, 5), (40, 1, 6)):
        book, queries = rng.integers(-span, span, (n, d)), rng.integers(-span, span, (400, d))
        index, best = vc.nearest(book, vc.kd_tree(book), queries)
        every = ((queries[:, None] - book[None]) ** 2).sum(2)
        assert (best == every.min(1)).all() and (index == every.argmin(1)).all()


def test_odd_vector_tables(spark):
    none = vectors(spark, [(1, None, 2), (2, [math.nan], 2)])
    assert vc.compressed(none).collect() == [] and vc.compressed(none.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    few = vectors(spark, [(None, [0.5] * 16, None), (None, [0.5] * 16, None)])
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vc.compressed(few).collect()] == [(None, "00" * 8, 0, 0)] * 2
    with pytest.raises(ValueError):
        vc.compressed(vectors(spark, [(1, [1e30] * 8, 1)])).collect()
    clash = few.withColumn("code", F.lit("x")).withColumn("made", F.lit(1)).withColumn("c0", F.lit(2))
    books = vc.fit_codebooks(vc.integers(clash, "vec_id", "embedding", "label", 8), 2, 4, 2, 8)
    made = vc.with_codes(clash, books)
    assert made.columns == ["vec_id", "embedding", "label", "made", "c0", "code"] and {r.code.error for r in made.collect()} == {0}


# ---- divergence -------------------------------------------------------------------------


def plain_divergence(rows, least_docs, smoothing=5, top=50):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least_docs]
        groups = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            groups[s].update(t for t in terms if df[t] >= least_docs)
        share = lambda c, n: 1 + math.floor(Fraction(10**9 * (c + smoothing), n + smoothing * len(kept)))
        every = sum(groups.values(), Counter())
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in groups.items()}
        q = {t: share(every[t], every.total()) for t in kept}
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def texts_of(seed, n=160):
    rnd = random.Random(seed)
    words = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)), "Ärger", "naïve", "ÉTÉ", "漢字", "a1b", "x y", "Über_all", "don't"]
    rows = [(" ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rnd.randrange(60))), rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "b", "ß", "", None, "solo"])) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "fr", "a"), ("zz", "fr", "b"), ("12 !", "it", "alone"), rows[0], rows[0], (" ".join(["long"] * 200_000), "en", "a")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_is_that_of_all_counts(spark, monkeypatch, small):
    if small:  # many blocks, tiles and steps
        for name, value in (("CELLS", 8), ("FEWEST_TERMS", 3), ("TILE", 2), ("BROADCAST_CELLS", 5), ("HELD", 50)):
            monkeypatch.setattr(dv, name, value)
    rows = texts_of(5)
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("count", F.lit(1)).withColumn("term", F.lit("x"))
    got = sorted(tuple(r) for r in dv.divergence(df, least_docs=6).collect())
    want = plain_divergence(rows, 6)
    assert got == want and {r[2] for r in want} == {"pair", "term"} and max(r[5] for r in want) > 5
    assert dv.divergence(df.limit(0)).collect() == []


def test_only_fifty_terms_and_ties_by_bytes(spark):
    # All terms of a source tie; those of equal value are in order of their bytes.
    names = [f"{a}{b}" for a in "zyxwvé漢" for b in "abcdefghij"]
    rows = [(" ".join(names), "en", "a")] * 3 + [("other words", "en", "b")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [r.item for r in dv.divergence(df, least_docs=3).filter("source = 'a' and part = 'term'").orderBy("rank").collect()]
    assert got == sorted(names, key=str.encode)[:50]


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(1)
    for _ in range(2000):
        total = rnd.randrange(1, 2**rnd.randrange(1, 53))
        count = rnd.randrange(0, total + 1) - 5
        assert int(dv.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 5) // total
