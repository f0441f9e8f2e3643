"""N-gram join against all pairs by brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from strata.llm import ngram_join
from strata.llm.components import connected_components
from strata.llm.ngram_join import choose_bands, keep_one, linked, ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """[(doc_id, class_id, n_links)] of (doc_id, text) rows with distinct ids."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    index = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in index.get(g, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((rows[i][0], least[find(i)], links[i]) for i in range(len(rows)))


def run(docs):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect())


def test_documents(documents, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs) == want
    assert sum(n > 0 for _, _, n in want) > 20


def near_copies(n, seed=3):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_large_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_MEMBERS", 8)
    rows = near_copies(60) + [(100 + i, t) for i, t in near_copies(5)] + [(200, "some other text of a few words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    assert ngram_jaccard_join(no_docs).collect() == []
    rows = ngram_jaccard_join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.class_id == r.doc_id
        assert r.n_links == 0
    assert keep_one(odd_docs).count() == odd_docs.count()
    assert keep_one(no_docs).count() == 0


def test_repeats_and_null_ids_are_copies(spark):
    text = "the same seven words in each row here"
    docs = spark.createDataFrame([(5, text), (5, text), (9, text), (None, text), (3, "other words that stand alone in this one")], "doc_id long, text string")
    rows = [(r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()]
    assert sorted(rows, key=str) == sorted([(5, 5, 3), (5, 5, 3), (9, 5, 3), (None, 5, 3), (3, 3, 0)], key=str)


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [1, 0, 4, 3, 2], [4, 3, 2, 1, 0]])
def test_an_id_with_several_texts_in_any_order(spark, order):
    """Each text keeps its own links; the classes of one id's texts merge."""
    (_, a), (_, b) = near_copies(1, 5) + near_copies(1, 6)
    close = b.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, b), (2, close), (4, a + " more"), (None, close + " again")]
    got = ngram_jaccard_join(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted([(1, 1, 1), (1, 1, 2), (2, 1, 2), (4, 1, 1), (None, 1, 2)], key=str)


def test_documents_of_one_template_form_no_chain(spark, monkeypatch):
    """Half of each text is shared: band buckets tie such texts, their sketches don't."""
    rnd = random.Random(7)
    shared = " ".join(f"t{i}" for i in range(130))
    rows = [(i, shared + " " + " ".join(f"w{rnd.randint(0, 10**7)}" for _ in range(80))) for i in range(250)]
    rows += [(1000 + i, t) for i, t in near_copies(6)]
    compared, real = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda members, threshold: compared.append(members.select("node").distinct().count()) or real(members, threshold))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert compared[0] < 30


def test_planted_pairs_at_the_threshold_are_found(spark):
    """Recall over pairs of similarity 0.8 to 0.95."""
    rnd = random.Random(8)
    rows = []
    for k in range(300):
        base = [f"w{rnd.randint(0, 10**7)}" for _ in range(150)]
        near = base[: 150 - rnd.randrange(4, 15)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*near, *(f"x{rnd.randint(0, 10**7)}" for _ in range(rnd.randrange(0, 3)))]))]
    want = brute(rows)
    assert sum(n for _, _, n in want) > 400
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_sketch_agreement():
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 1 << 63, 120).astype(np.uint64)
    b = np.where(rnd.random(120) < 0.8, a, rnd.integers(0, 1 << 63, 120).astype(np.uint64))
    x, y = ngram_join._unpacked([ngram_join.pack_sketch(a), ngram_join.pack_sketch(b)], 120)
    assert (x[a == b] == y[a == b]).all() and (x == y).sum() >= (a == b).sum()
    assert ngram_join._unpacked([ngram_join.pack_sketch(a[:7])], 7).shape == (1, 7)
    assert 65 <= ngram_join.sketch_limit(120, 0.8) < 80


def test_keep_one_keeps_the_smallest_of_each_class(spark):
    rows = near_copies(12) + [(50, "a text that nothing else is like in any way at all"), (51, None), (52, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone_doc_id string")
    kept = sorted(r.doc_id for r in keep_one(docs).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})
    assert keep_one(docs).columns == docs.columns


def test_band_choice():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        b, r = choose_bands(threshold, 0.999, 256)
        assert 1 - (1 - threshold**r) ** b >= 0.999
        assert b * r <= 256
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999, 4)


def test_linked_matrix_equals_set_arithmetic():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 30, rnd.integers(1, 25)).astype(np.uint64)) for _ in range(40)]
    got = linked(sets[:25], sets[25:], 0.4)
    for i, a in enumerate(sets[:25]):
        for j, b in enumerate(sets[25:]):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (len(x & y) >= 0.4 * len(x | y) - 1e-9)


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
