"""Scores, choices and pseudonyms against plain versions, one text, word or letter at a time."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veloquy.llm import brown_lm, grams, language_id, mixing, pii, quality_classifier, toxicity
from veloquy.llm import textnum as tn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()
    return ["", " \n", "x", "Grüße, 12!", "a a a b", None, *(r.text for r in rows)]


def buckets(word, lengths, n):
    w = tn.words(pa.array([word]))
    found, bounds = grams.word_grams(w, lengths, n)
    assert bounds.tolist() == [0, len(found)]
    return found


def test_toxicity_scores(texts):
    rnd = np.random.default_rng(0)
    known = tn.words(pa.array(["the of and der die das"])).hashes()
    order = np.argsort(known)
    model = toxicity.ToxicityModel(rnd.normal(0, 1, toxicity.BUCKETS).astype(np.float32), known[order], rnd.normal(0, 1, len(known)), -0.3)
    own = dict(zip(model.words.tolist(), model.by_word, strict=True))
    got = model.score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        words = sorted({w.translate(LOWER) for w in WORD.findall(text or "")})
        each = []
        for w in words:
            b = buckets(w, toxicity.LENGTHS, toxicity.BUCKETS)
            each.append(model.by_bucket[b].astype(float).mean() / 2 + own.get(int(tn.words(pa.array([w])).hashes()[0]), 0.0) / 2 if len(b) else own.get(int(tn.words(pa.array([w])).hashes()[0]), 0.0) / 2)
        logit = (sum(each) / len(each) if each else 0.0) + model.bias
        assert math.isclose(score, 1 / (1 + math.exp(-logit)), rel_tol=1e-5)


def test_language_word_scores(texts):
    model = language_id.fit_language(["one two three four", "eins zwei drei vier", "один два три"], ["en", "de", "ru"])
    some = [t for t in texts[:12] if t]
    w = tn.words(pa.array(some))
    scores, letters = model.word_scores(w)
    for k, word in enumerate(x for t in some for x in WORD.findall(t)):
        assert letters[k] == sum(c.isalpha() for c in word)
        b = buckets(word, language_id.LENGTHS, language_id.BUCKETS)
        plain = model.table[b].astype(float).sum(0) / len(language_id.LENGTHS) if letters[k] else np.zeros(3)
        usable = scores[k] > plain.min() - 40 if letters[k] else np.ones(3, bool)
        assert usable.any() and np.allclose(scores[k][usable], plain[usable], rtol=1e-4, atol=1e-4)
        if letters[k] and word.isascii():
            assert usable.tolist() == [True, True, False]  # no Latin letters in the third


def plain_features(text):
    text = text or ""
    raw, words = text.encode(), WORD.findall(text)
    size, n, chars = max(len(raw), 1), max(len(words), 1), max(sum(map(len, words)), 1)
    count = lambda marks: sum(text.count(c) for c in marks)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, again = set(), 0
    for x in lines:
        again += len(x) if x in seen else 0
        seen.add(x)

    def covered(k):
        times = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        hit = {j for i in range(len(words) - k + 1) if times[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
        return sum(len(words[j]) for j in hit)

    width = [len(x.encode()) for x in words]
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words))) - math.log1p(len(words)), upper / max(upper + lower, 1), count("#*$%&|<>") / chars,
        count("0123456789") / size, count("!?") / n, count(".") / n, count(",") / n, count("|") / n, count("#*$%&") / n,
        sum(b >= 128 for b in raw) / size, len(lines) / n, math.log1p(len(words) / max(len(lines), 1)), again / max(sum(map(len, lines)), 1),
        covered(5) / chars, covered(10) / chars, len(set(words)) / n, sum(x <= 3 for x in width) / n, sum(x >= 15 for x in width) / n, count("{}[]()=;_\\/@\"'") / n,
    ]


def test_quality_features_and_scores(texts):
    assert np.allclose(quality_classifier.features(pa.array(texts)), [plain_features(t) for t in texts])
    labels = np.array([i % 2 for i in range(len(texts))])
    model = quality_classifier.fit_quality([t or "" for t in texts], labels)
    for text, score in zip(texts, model.score(pa.array(texts)), strict=True):
        raw = sum(model.weights[i][sum(x >= c for c in model.cuts[i])] for i, x in enumerate(plain_features(text)))
        z = (raw - model.threshold) * model.slope + math.log(0.7 / 0.3)
        assert math.isclose(score, 1 / (1 + math.exp(-max(min(z, 30), -30))), rel_tol=1e-6)


def water_filling(total):
    """Targets by rounds: sources above three times their size stop there, the rest is shared anew."""
    names = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    left = float(sum(total.values()))
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * total[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mixed_by_source(spark, rows):
    """[(source, target, size, repeats of each row)] of the mix of (id, words, source)."""
    df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mixed(df.repartition(3)).collect():
        assert r.mix.size == len(r.text) // 2 and 0 <= r.mix.repeats <= 3
        by.setdefault(r.source, []).append(r.mix)
    want = water_filling({s: sum(m.size for m in ms) for s, ms in by.items()})
    for s, ms in by.items():
        assert all(math.isclose(m.target, want[s], rel_tol=1e-9) for m in ms)
    return {s: (want[s], [m.size for m in ms], [m.repeats for m in ms]) for s, ms in by.items()}


def misses(found):
    return {s: abs(target - sum(n * r for n, r in zip(sizes, repeats, strict=True))) for s, (target, sizes, repeats) in found.items()}


def test_small_sources_have_the_best_subset(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 1, 5, 40, 300, rnd.randrange(2000)]), rnd.choice(["a", "b", "c", "d", "e", None])) for i in range(60)]
    rows = [r for k, r in enumerate(rows) if sum(x[2] == r[2] for x in rows[:k]) < mixing.AROUND]
    found = mixed_by_source(spark, rows)
    for s, (target, sizes, repeats) in found.items():
        whole = min(int(target // sum(sizes)), 3)
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        assert set(repeats) <= {whole, whole + 1}
        assert math.isclose(misses(found)[s], min(abs(target - whole * sum(sizes) - x) for x in sums), abs_tol=1e-6)


def test_large_sources_and_few_long_documents(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice([0, 1, 5, 40, 300]), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    assert max(misses(mixed_by_source(spark, rows)).values()) < 1
    # One long document among short ones, and sources of one document or of equal ones.
    rows = [(1, 90_000, "a"), *[(10 + i, 7, "a") for i in range(40)], *[(100 + i, 1000 + i % 2, "b") for i in range(200)], (900, 1000, "c")]
    got = misses(mixed_by_source(spark, rows))
    assert got["a"] <= 45_000 and got["b"] <= 500 and got["c"] == 0
    assert misses(mixed_by_source(spark, [(1, 1000, "a"), (2, 1000, "b")])) == {"a": 1000 - 2000 / 3, "b": 4000 / 3 - 1000}
    # Where the cut falls into long documents, shorter ones behind it fill what is missing.
    rows = [(i, 5000, "a") for i in range(60)] + [(100 + i, 3, "a") for i in range(8000)] + [(9000, 200_000, "b")]
    assert misses(mixed_by_source(spark, rows))["a"] <= 1.5


def test_identical_rows_are_taken_one_by_one(spark):
    for n in (10, 300):
        found = mixed_by_source(spark, [(1, 100, "a")] * n + [(2, 100, "b")] * n)
        assert max(misses(found).values()) <= 50 and len(found["a"][1]) == n


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mix_is_near_its_targets_at_every_size(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "source")
    sums = mixing.mixed(docs).groupBy("source").agg({"mix.target": "max", "mix.source_size": "max"}).collect()
    taken = {r.source: r.taken for r in mixing.mixed(docs).selectExpr("source", "mix.size * mix.repeats as taken").groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    targets = {r.source: r[1] for r in sums}
    assert len(targets) == 20 and all(abs(taken[s] - t) <= 0.02 * t for s, t in targets.items())


def test_mail_pseudonyms(spark):
    def shift(n, j, i, other):
        return int(hashlib.sha256(f"k|email{n}.{j}|{i}|{other}".encode()).hexdigest()[:15], 16) % 260_000

    def moved(part, other, n, i):
        out = ""
        for j, c in enumerate(part, 1):
            low, size = (48, 10) if c in "0123456789" else (65, 26) if "A" <= c <= "Z" else (97, 26)
            out += chr(low + (ord(c) - low + shift(n, j, i, other)) % size) if c.isalnum() else c
        return out

    mails = ["a@b.co", "Jo.Smith-9@mail.example.com", "x_y%z+w@q.org", "UPPER@d.de"]
    rows = pii.pseudonymised(spark.createDataFrame([(i, f"to {m}!") for i, m in enumerate(mails)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for mail, r in zip(mails, rows, strict=True):
        local, domain = mail.split("@")
        n, cut = len(local), (len(local) + 1) // 2
        a, b = local[:cut], local[cut:]
        for i in range(1, pii.ROUNDS + 1):
            a, b = (moved(a, b, n, i), b) if i % 2 else (a, moved(b, a, n, i))
        assert r.text == f"to {a}{b}@{domain}!" and r.pii[0].old == mail


def test_brown_scores(spark, monkeypatch, texts):
    monkeypatch.setattr(brown_lm, "TOP", 20)
    held, kept = {}, {}
    fit, store = brown_lm.fit_brown, brown_lm.stored
    monkeypatch.setattr(brown_lm, "fit_brown", lambda *a: held.setdefault("model", fit(*a)))
    monkeypatch.setattr(brown_lm, "stored", lambda df, label: kept.setdefault(label, store(df, label)))
    monkeypatch.setattr(brown_lm, "discard", lambda *tables: None)  # they are looked at below
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in brown_lm.brown_scores(df, F.col("doc_id") % 5 == 1, block_rows=20).collect()}
    class_of = {r.word: r["class"] for r in kept["words"].collect()}
    model, top = held["model"], len(held["model"].items.keys)

    def tokens(text):
        key, form, _ = brown_lm.tokens(pa.array([text or ""]))
        return [(int(k), int(f)) for k, f in zip(key.view(np.int64), form, strict=True)]

    rows = [tokens(t) for t in texts]
    train = [r for i, r in enumerate(rows) if i % 5 != 1]
    count = collections.Counter(k for r in train for k, _ in r)
    form_of = {k: f for r in train for k, f in r}
    klass = lambda k, f: class_of[k] if class_of.get(k, -1) >= 0 else int(model.cls[top + f])
    end = (int(np.array([brown_lm.END]).view(np.int64)[0]), brown_lm.SHAPES - 1)
    pairs = collections.Counter((klass(*a), klass(*b)) for r in train for a, b in zip([end, *r], r, strict=False))
    after, before = collections.Counter(), collections.Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        after[b] += n
    whole = sum(pairs.values())

    def follows(a, b):
        kinds = sum(x == a for x, _ in pairs) + 1
        share = (after[b] + 0.5) / (whole + 0.5 * brown_lm.CLASSES)
        return (pairs[a, b] + kinds * share) / (before[a] + kinds)

    own = collections.Counter()
    for k, n in count.items():
        if class_of.get(k, -1) >= 0:
            own[class_of[k]] += n
    rare = {f: [n for k, n in count.items() if form_of[k] == f and class_of.get(k, -1) < 0] for f in range(brown_lm.SHAPES)}
    mass = collections.Counter(own)
    for f in range(brown_lm.SHAPES):
        mass[int(model.cls[top + f])] += sum(rare[f]) + 0.01

    def emits(k, f):
        c = klass(k, f)
        if class_of.get(k, -1) >= 0:
            return count[k] / mass[c]
        p = (sum(rare[f]) + 0.01) / mass[c]
        if f == brown_lm.SHAPES - 1:
            return p
        once, twice = rare[f].count(1), rare[f].count(2)
        d = min(max(once / max(once + 2 * twice, 1) if once else 0.5, 0.05), 0.95)
        if count[k]:
            return p * (count[k] - d) / sum(rare[f])
        return p * (d * max(len(rare[f]), 1) / sum(rare[f]) if rare[f] else 1.0)

    for i, r in enumerate(rows):
        want = sum(math.log10(follows(klass(*a), klass(*b)) * emits(*b)) for a, b in zip([end, *r], r, strict=False))
        assert math.isclose(got[i].score, want, rel_tol=1e-6), (i, got[i].score, want)
