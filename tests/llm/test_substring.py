"""Repeated 35-word windows against a plain count of all windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import substring, vec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
W = substring.WINDOW


def brute(texts):
    """Kept words of each text."""
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + W]) for w in words for i in range(len(w) - W + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - W + 1) if n[tuple(w[i : i + W])] > 1 for j in range(i, i + W)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


def check(spark, docs, extra="", rest=()):
    got = substring.substring_dedup(spark.createDataFrame([(*d, *rest) for d in docs], "doc_id long, text string" + extra)).collect()
    words, kept = brute([t for _, t in docs])
    want = [(i, len(w), len(w) - len(k), " ".join(k)) for (i, _), w, k in zip(docs, words, kept, strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.n_removed == len({j for s in r.spans or [] for j in range(s.lo, s.hi)})
    return got


def prose(rnd, n, vocabulary=4000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(rnd):
    passages = [prose(rnd, n) for n in (34, 35, 36, 50, 51, 90, 400)]
    docs = []
    for i in range(150):
        words = prose(rnd, rnd.choice([0, 3, 34, 35, 60, 500]))
        for p in rnd.sample(passages, rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = p
        docs.append((i, rnd.choice([" ", "\n", " \t\n", "  "]).join(words)))
    docs += [(200 + i, docs[i][1]) for i in range(10)]
    return docs


def test_planted_passages(spark):
    check(spark, corpus(random.Random(1)))


def test_small_pieces_packings_and_buckets(spark, monkeypatch):
    """Long texts are cut, a window may lie across any cut, and strings are packed many times."""
    for name, value in (("PIECE_BYTES", 700), ("PACK_BYTES", 2000), ("BUCKET_BYTES", 5000), ("RUN_WINDOWS", 7)):
        monkeypatch.setattr(substring, name, value)
    monkeypatch.setattr(substring.text_pieces, "__defaults__", (700,))
    rnd = random.Random(2)
    docs = corpus(rnd)
    docs += [(900, " ".join(["x" * 900, *prose(rnd, 80), "y" * 3000, "z"] * 3)), (901, "q" * 5000)]
    check(spark, docs)


def test_frequent_runs_come_last(spark, monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT_BYTES", 200)
    rnd = random.Random(3)
    common = prose(rnd, 60)
    docs = [(i, " ".join(prose(rnd, 30) + common + prose(rnd, 30))) for i in range(300)]
    check(spark, docs + [(1000, " ".join(common[:35])), (1001, " ".join(common[1:35]))])
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring.frequent_runs(rows, sum(len(t) for _, t in docs))
    assert len(common) - 4 <= len(found) < len(common) + 10


def test_one_word_and_one_line_over_and_over(spark):
    check(spark, [(0, "x " * 20_000), (1, "x " * 35), (2, "x " * 34), (3, "a b c d e f g\n" * 3000), (4, "b c d e f g a " * 6), (5, "one two")])


def test_odd_rows_with_clashing_columns(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs += [(7, " ".join(prose(random.Random(4), 40)))] * 3 + [(None, docs[-1][1])] * 2
    check(spark, docs, ", a string, b long, spans string, lo long, words string", ("s", 3, None, 4, "x"))


def test_very_long_text(spark):
    rnd = random.Random(5)
    long = prose(rnd, 400_000, 60_000)
    check(spark, [(0, " ".join(long)), (1, " ".join(long[200_000:200_060])), (2, " ".join(long[-35:])), (3, " ".join(prose(rnd, 500)))])


def test_empty_tables(spark, no_docs, odd_docs):
    assert substring.substring_dedup(no_docs).collect() == []
    rows = substring.substring_dedup(odd_docs.where("text is null")).collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == [(0, 0, "")]


def test_windows_of_one_hash_are_compared_by_their_words(monkeypatch):
    rnd = np.random.default_rng(6)
    ids = rnd.integers(0, 3, 5000)
    ids[300:400] = ids[100:200]
    first = np.arange(len(ids) - W + 1)
    times = rnd.integers(1, 2, len(first))
    want = substring.repeated_windows(ids, first, times)
    n = Counter(ids[i : i + W].tobytes() for i in first)
    assert want.tolist() == [n[ids[i : i + W].tobytes()] > 1 for i in first]
    monkeypatch.setattr(vec, "span_hashes", lambda values, starts, ends: (starts % 50).astype(np.uint64))
    assert (substring.repeated_windows(ids, first, times) == want).all()


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 31])
def test_sliding_least(width):
    x = np.random.default_rng(width).integers(0, 100, 200).astype(np.uint64)
    assert substring._sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_packings_and_hashing_are_bounded_by_what_they_hold(monkeypatch):
    """A packing counts the strings that it holds (a copy is not held again), and windows are hashed a few at a time."""
    pack = substring._Packer(4)
    one = np.zeros(1, np.int64)
    pack.add(np.zeros(1, np.uint64), [b"w " * 5000], one, one, one)
    held = pack.used
    assert held >= 10_000
    for i in range(50):
        pack.add(np.zeros(1, np.uint64), [b"w " * 5000], one, one + i, one)
    assert pack.used < held + 50 * 200
    asked, real = [], substring.vec.span_hashes
    monkeypatch.setattr(substring, "HASHED_WINDOWS", 64)
    monkeypatch.setattr(substring.vec, "span_hashes", lambda v, s, e: asked.append(len(v)) or real(v, s, e))
    ids = np.tile(np.arange(500), 2)
    first = np.arange(len(ids) - substring.WINDOW + 1)
    again = substring.repeated_windows(ids, first, np.ones(len(first), np.int64))
    want = [(ids[i : i + substring.WINDOW].tolist() in [ids[j : j + substring.WINDOW].tolist() for j in (i - 500, i + 500) if 0 <= j < len(first)]) for i in first]
    assert again.tolist() == want and max(asked) <= 64 + substring.WINDOW
