"""Ranked lexical search against a plain rendering of its rule."""

import math
import re
from collections import Counter

import pytest
from litspark.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs if d is not None]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in q.items() if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


DOCS = [
    (1, "The cat sat. THE cat, the end!"), (2, "a dog; a cat"), (3, None), (4, ""), (5, "... --- !!!"), (6, "Étude ÉTUDE étude cat_dog x\x00y"),
    (7, "a dog; a cat"), (7, "a dog; a cat"), (8, "word " * 30_000 + "cat"), (9, " cat dog 東京 2024"), (None, "cat cat cat"), (-4, "a dog; a cat"),
]
ITEMS = [(10, "cat Cat CAT dog"), (11, "étude 東京"), (12, None), (13, "nowhere"), (14, "a end"), (14, "dog"), (None, "cat"), (15, "word")]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("entries", [L.ENTRIES, 3])
def test_against_brute_force(spark, entries):
    """One block of items and several give the same."""
    got = L.search(*frames(spark), entries=entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(DOCS, ITEMS)


def test_blocks_of_documents_and_ties(spark, monkeypatch):
    """Many blocks; more equal scores than places, which go to the smallest ids."""
    docs = [(i, f"common w{i % 9} w{i % 4} rare{i}") for i in range(400)] + [(1000 + i, "common same") for i in range(40)]
    items = [(1, "common same"), (2, "w3 w3 w1 common"), (3, "rare7 w2")]
    monkeypatch.setattr(L, "BLOCK_BYTES", 500)
    got = sorted(map(tuple, L.search(*frames(spark, docs, items)).collect()))
    assert got == brute(docs, items)
    assert [d for i, _, d, _ in got if i == 1] == list(range(1000, 1010))


def test_empty_tables_and_clashing_columns(spark):
    docs, items = frames(spark)
    assert L.search(docs.limit(0), items).collect() == [] and L.search(docs, items.limit(0)).collect() == []
    more = [c.selectExpr("*", "1 as rank", "2 as score", "3 as raw", "4 as term", "5 as n_docs") for c in (docs, items)]
    assert sorted(map(tuple, L.search(*more).collect())) == brute(DOCS, ITEMS)


def test_product_merges_term_rows():
    """The block product on a small matrix: rows of the item's terms are merged with their multiplicities."""
    import numpy as np

    items = L.Items({5: Counter({b"x": 2, b"y": 1})})
    sizes, terms, dfs, docs, tfs = L.term_document([b"x x y", b"z", b"y"], items.vocabulary)
    assert sizes.tolist() == [3, 1, 1] and terms.tolist() == [0, 1] and dfs.tolist() == [1, 2] and docs.tolist() == [0, 0, 2] and tfs.tolist() == [2, 1, 1]
    ((i, ids, scores),) = L.multiply(items, np.array([7, 3]), np.array([30, 20, 10]), sizes, terms, dfs, docs, tfs, 3, 5, 10)
    one = lambda tf, n: 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * 3 // 5))
    assert i == 0 and ids.tolist() == [30, 10] and scores.tolist() == [2 * 7 * one(2, 3) + 3 * one(1, 3), 3 * one(1, 1)]
