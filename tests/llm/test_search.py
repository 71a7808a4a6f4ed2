"""Ranked search against a plain ranking, with nulls, ties, repeated rows and extra columns."""

import collections
import math
import random
import re

import pytest

from stayrate.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Extra columns whose names the operator uses inside.
SCHEMA = "doc_id long, text string, row long, term string, item long, score long, id string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k):
    counted = [(doc_id, collections.Counter(terms(text))) for doc_id, text in rows]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    frequency = collections.Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in frequency.items()}
    found = []
    for item_id, text in set(items):
        scored = []
        for (doc_id, c), n in zip(counted, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        found += [(item_id, rank, doc_id, -minus) for rank, (minus, _, doc_id) in enumerate(scored[:k], 1)]
    return found


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    words = ["the", "of", "and", "été", "x1", "Zoo", "日本", *(f"w{i}" for i in range(300))]
    weights = [400, 300, 200, 30, 20, 20, 10, *(60 / (1 + i) for i in range(300))]
    texts = [None, "", " .,;\n", "The THE the", "the", "É é", "a" * 3000, "of " * 2000, "w1-w2_w3\x00w4"]
    texts += [" ".join(draw.choices(words, weights, k=draw.randint(1, 80))) for _ in range(900)]
    texts += ["the of zoo"] * 120  # many equal scores
    found = [(i, t, 7, "t", 8, 9, "i") for i, t in enumerate(texts)]
    return [*found, found[20], (None, "zoo w7 w9", 7, "t", 8, 9, "i"), (None, "zoo w7 w9", 7, "t", 8, 9, "i")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def asked(rows):
    draw = random.Random(4)
    long = " ".join(f"w{i}" for i in range(150)) + " the of and"  # more terms than fit one word of bits
    found = [(0, "the zoo"), (1, None), (2, ""), (3, "unknownword"), (4, "The of AND été été"), (5, long), (None, "w7 w9"), (6, "the"), (6, "the"), (6, "of")]
    return found + [(10 + i, draw.choice(rows[10:900])[1]) for i in range(25)]


def _ranking(spark, docs, asked, k):
    items = spark.createDataFrame([(i, t, 1, "e") for i, t in asked], "item_id long, text string, nr int, doc_id string")
    return sorted((tuple(r) for r in ranked_search.search(docs, items, k).collect()), key=str)


@pytest.mark.parametrize("k", [1, 50])
def test_ranking(spark, docs, rows, asked, k):
    assert _ranking(spark, docs, asked, k) == sorted(plain([r[:2] for r in rows], asked, k), key=str)


def test_ranking_in_small_steps(spark, docs, rows, asked, monkeypatch):
    """Short blocks, coarse lower ends and several blocks of items: the result stays."""
    monkeypatch.setattr(ranked_search, "DEPTH", 2)
    monkeypatch.setattr(ranked_search, "GROWTH", 5)
    monkeypatch.setattr(ranked_search, "STEPS", 50)
    monkeypatch.setattr(ranked_search, "TERMS_AT_A_TIME", 200)
    assert _ranking(spark, docs, asked, 5) == sorted(plain([r[:2] for r in rows], asked, 5), key=str)


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.search(spark.createDataFrame([], SCHEMA), some).count() == 0
    assert ranked_search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), some).count() == 0
