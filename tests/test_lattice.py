"""The cheapest path against all segmentations, and search by its terms."""

import itertools
import random

from veloquy.functions import lattice
from veloquy.functions.query import parse_query
from veloquy.operators import search

WORDS = [("成年", "名詞", 3.0, "成年"), ("後見", "名詞", 3.0, "後見"), ("成年後", "名詞", 4.5, "成年後"), ("見", "動詞", 6.0, "見る"), ("の", "助詞", 1.0, "の"), ("制度", "名詞", 2.5, "制度"), ("制", "名詞", 5.0, "制"), ("度", "名詞", 5.0, "度"), ("、", "補助記号", 0.5, "、"), ("サーバー", "名詞", 3.0, "サーバ"), ("ば", "助詞", 1.0, "ば")]
JOINS = {("名詞", "助詞"): -0.5, ("名詞", "動詞"): 2.0, ("助詞", "助詞"): 3.0, ("", "助詞"): 4.0}


def cheapest(found, text):
    """Cost of the best of all ways through a text, by trying them all."""

    def ways(at, cls):
        if at == len(text):
            yield 0.0
        for w in found.words_at(text, at) if at < len(text) else []:
            for rest in ways(at + len(w[0]), w[1]):
                yield found.joins.get((cls, w[1]), 0.0) + w[2] + rest

    return min(ways(0, ""))


def test_the_path_is_the_cheapest_of_all():
    rnd = random.Random(3)
    for seed in range(60):
        words = [("".join(rnd.choices("あい漢字ア", k=rnd.randrange(1, 4))), rnd.choice("XYZ"), rnd.uniform(0.1, 5), "f") for _ in range(14)]
        joins = {(a, b): rnd.uniform(-1, 2) for a, b in itertools.product(["", *"XYZ"], "XYZ") if rnd.random() < 0.6}
        found = lattice.Lattice(words, joins)
        text = "".join(rnd.choices("あい漢字アb 。", k=rnd.randrange(0, 9)))
        path = found.path(text)
        assert "".join(w[0] for w in path) == text
        cost = sum(w[2] + joins.get((a[1] if a else "", w[1]), 0.0) for a, w in zip([None, *path], path, strict=False))
        assert abs(cost - (cheapest(found, text) if text else 0.0)) < 1e-9, (seed, text)


def test_terms_and_dropped_classes():
    found = lattice.Lattice(WORDS, JOINS)
    assert found.terms("成年後見の制度") == ["成年", "後見", "制度"]
    assert found.terms("サーバーの制、ABC予算ば") == ["サーバ", "制", "abc", "予算"]
    assert found.terms(None) == found.terms("") == found.terms(" 。あ") == []


def test_search_by_terms_and_costs_from_texts(spark):
    kind = "surface string, cls string, cost double, form string"
    words, joins = lattice.read_dictionary(spark.createDataFrame(WORDS, kind), spark.createDataFrame([(a, b, c) for (a, b), c in JOINS.items()], "left string, right string, cost double"))
    rows = spark.createDataFrame([(1, "成年後見の制度、制度"), (2, "後見の制度"), (3, "成年の予算"), (4, None)], "i int, text string")
    terms = lattice.with_terms(rows, "text", words, joins)
    assert {r.i: r.tokens for r in terms.collect()} == {1: ["成年", "後見", "制度", "制度"], 2: ["後見", "制度"], 3: ["成年", "予算"], 4: []}
    query = parse_query("成年制度", lattice.Lattice(words, joins).terms)
    assert query.terms == ("成年", "制度")
    hits = search.top(search.bm25(terms, query, tokens_col="tokens"), 3, "i").collect()
    assert [r.i for r in hits] == [1, 2, 3]
    more = rows.union(spark.createDataFrame([(5, "後見人の後見")], "i int, text string"))
    learned = lattice.learned_costs(more, "text", [(s, c, 0.0, f) for s, c, _, f in words])
    cost = {w[0]: w[2] for w in learned}
    assert cost["制度"] < cost["制"] and cost["後見"] < cost["成年後"] and cost["の"] < cost["ば"]
