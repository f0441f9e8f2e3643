"""Ranked search over K2-treaps against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import lexical
from strata.sources.tables import shared_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n = sum(c > 0 for _, _, c in bags)
    length = sum(c for _, _, c in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item_id, text in sorted(set(items), key=str):
        hits = []
        for doc_id, bag, size in bags:
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * (75 + 25 * size * n // length)))
            if score > 0:
                hits.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], start=1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=20, extra=""):
    d = spark.createDataFrame(docs, "doc_id long, text string" + extra)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, lexical.ranked_search(d, i, k).collect()), key=str)
    assert got == brute([r[:2] for r in docs], items, k)
    return got


def random_docs(rnd, n):
    words = [f"w{int(rnd.paretovariate(0.6)) % 500}" for _ in range(3000)]
    return [(x, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40, 300])))) for x in rnd.sample(range(10 * n), n)]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_random_documents(spark, k):
    rnd = random.Random(k)
    items = [(j, " ".join(f"w{int(rnd.paretovariate(0.5)) % 520}" for _ in range(rnd.choice([1, 3, 30])))) for j in range(40)]
    check(spark, random_docs(rnd, 700), items, k)


def test_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text, r.source, r.lang) for r in odd_docs.collect()]
    items = [(1, "word WORD same LINE"), (1, "é 漢字 ½"), (2, None), (3, ""), (None, "null id text"), (4, "x" * 5000), (4, "x" * 5000), (5, "nowhere")]
    assert check(spark, docs, items, extra=", item_id string, score string")


def test_thousands_of_equal_scores(spark):
    """Copies tie: the smallest ids win, whatever order they come in."""
    ids = random.Random(1).sample(range(100_000), 3000)
    docs = [(i, "one and the same text") for i in ids] + [(200_000 + i, f"other {i}") for i in range(2000)]
    got = check(spark, docs, [(0, "same text"), (1, "other")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 0] == sorted(ids)[:20]


def test_very_long_text_and_rounds_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROUND_BYTES", 200)
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 2)
    docs = [(0, "many words here " * 200_000), (1, "words"), (2, "here " * 50), (None, "many")]
    check(spark, docs, [(j, t) for j, t in enumerate(["many here", "words", "words here " * 30, "here", "none", "many many words"])])


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(no_docs, items).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lexical.ranked_search(docs, items.limit(0)).collect() == []
    assert lexical.ranked_search(docs.where("text is null"), items).collect() == []


def test_an_index_serves_several_searches(spark, documents):
    folder = shared_folder(spark, "test-index")
    lexical.write_index(documents, folder)
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    for words in ("the and of", "quality"):
        items = [(1, words), (2, docs[5][1])]
        got = lexical.search_index(spark, folder, spark.createDataFrame(items, "item_id long, text string"), 5).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items, 5)


def test_cells_hold_the_largest_impact_below():
    rnd = np.random.default_rng(4)
    term, column = rnd.integers(0, 90, 4000).astype(np.uint64), rnd.integers(0, 70, 4000)
    grid = lexical.build_grid(np.arange(70), term, column, 70, 4000)
    cells = len(grid.level) - len(grid.children)
    assert cells == len(set(zip(term.tolist(), column.tolist())))
    for j, table in enumerate(grid.children):
        kids = table[table >= 0]
        assert len(kids) > 1 and grid.most[cells + j] == grid.most[kids].max() and (grid.level[kids] > grid.level[cells + j]).all()
    back = lexical.Grid.of(grid.row())
    for f in lexical.Grid.FIELDS:
        assert (getattr(back, f) == getattr(grid, f)).all()
