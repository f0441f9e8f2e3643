"""Fingerprints against a plain version, and the multiset properties."""

from __future__ import annotations

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from strata.llm.fingerprint import add_words, as_text, edited_fingerprints, fingerprints, likeness, likeness_of_text, subtract_words, with_words, words_of_text

MASK = (1 << 60) - 1
SPREAD = 1 | 1 << 30


def spark_hash(seed: int, text: str) -> int:
    start = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    return xxhash.xxh64_intdigest(text.encode(), start)


def words(text):
    parts = [p for p in (text or "").split("\n") if p]
    fine = [s for p in parts for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", p)]
    out = []
    for seed in (11, 12):
        h = [spark_hash(seed, s) for s in fine]
        out += [sum((x >> j) & SPREAD for x in h) & MASK for j in range(30)]
    out += [sum(spark_hash(seed, p) & MASK for p in parts) & MASK for seed in (21, 22)]
    return [*out, len(fine), len(parts)]


def hexed(w):
    return "".join(f"{x:015X}" for x in w)


def alike(a, b):
    va = [2 * ((w >> 30 * j) & 0x3FFFFFFF) - a[-2] for w in a[:60] for j in range(2)]
    vb = [2 * ((w >> 30 * j) & 0x3FFFFFFF) - b[-2] for w in b[:60] for j in range(2)]
    norm = sum(x * x for x in va) + sum(x * x for x in vb)
    return 1.0 if not norm else max(0.0, min(1.0, 2 * sum(x * y for x, y in zip(va, vb, strict=True)) / norm))


def check(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie), reverse=True)
    want = []
    for i, r in enumerate(rows):
        nxt, n = rows[(i + 1) % len(rows)].text, len(r.text)
        edited = r.text[: n - n // 2] + nxt[: n // 2]
        a, b, c = words(r.text), words(edited), words(nxt)
        want.append((str(r.doc_id), n, hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in edited_fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)
    return got


def test_documents(documents):
    got = check(documents)
    assert sum(r[5] > r[6] for r in got) > 0.85 * len(got)  # half a text is alike, the next one is not


def test_likeness_of_the_returned_strings(documents, odd_docs):
    for docs in (documents, odd_docs):
        rows = edited_fingerprints(docs).withColumn("read", likeness_of_text(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
        assert rows
        assert all(r.read == r.near_edited for r in rows)
    none = documents.select(likeness_of_text(F.lit("12"), F.lit(None).cast("string")).alias("x")).first()
    assert none.x is None


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_empty_and_single(no_docs, spark):
    assert edited_fingerprints(no_docs).collect() == []
    one = edited_fingerprints(spark.createDataFrame([(7, "a b\nc d")], "doc_id long, text string")).collect()
    assert len(one) == 1
    assert one[0].near_next == 1.0


def test_order_insertion_deletion(spark):
    texts = [(1, "one.\ntwo.\nthree."), (2, "three.\none.\ntwo."), (3, "one.\ntwo."), (4, "three."), (5, "one.\none.\ntwo.\nthree.")]
    fp = fingerprints(spark.createDataFrame(texts, "doc_id long, text string"))
    row = fp.groupBy().pivot("doc_id", [1, 2, 3, 4, 5]).agg(F.first("words"))
    r = row.select(
        as_text(F.col("1")).alias("a"), as_text(F.col("2")).alias("b"), as_text(add_words(F.col("3"), F.col("4"))).alias("added"),
        as_text(subtract_words(F.col("1"), F.col("4"))).alias("removed"), as_text(F.col("3")).alias("c"), as_text(F.col("5")).alias("twice"),
        likeness(F.col("1"), F.col("2")).alias("same"), likeness(F.col("1"), F.col("5")).alias("near"),
    ).first()
    assert r.a == r.b == r.added
    assert r.removed == r.c
    assert r.twice != r.a  # a multiset: a repeated paragraph counts
    assert r.same == 1.0
    assert 0.5 < r.near < 1.0


def exact_likeness(a, b):
    """From per-lane counts that are plain integers."""
    def lanes(text):
        parts = [p for p in text.split("\n") if p]
        fine = {}
        for s in (s for p in parts for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", p)):
            fine[s] = fine.get(s, 0) + 1
        h = [(spark_hash(seed, s), n) for seed in (11, 12) for s, n in fine.items()]
        half, size = len(fine), sum(fine.values())
        return [2 * sum(n for x, n in own if x >> j & 1) - size for own in (h[:half], h[half:]) for j in range(60)]

    va, vb = lanes(a), lanes(b)
    return max(0.0, min(1.0, 2 * sum(x * y for x, y in zip(va, vb, strict=True)) / sum(x * x + y * y for x, y in zip(va, vb, strict=True))))


def test_lanes_of_very_long_texts(spark):
    """More sentences than 15 bits count: repeated lines, and two texts that share nothing."""
    repeated = ["one short line\n" * 40_000, "another such line\n" * 40_000, "one short line\n" * 39_000 + "another such line\n" * 1_000]
    long = ["\n".join(f"{k} {i}" for i in range(70_001)) for k in "ab"]
    texts = [*repeated, *long, long[0][: len(long[0]) // 2]]
    pairs = [(0, 1), (0, 2), (3, 4), (3, 5), (3, 3)]
    rows = spark.createDataFrame([(k, texts[i], texts[j]) for k, (i, j) in enumerate(pairs)], "k long, a string, b string")
    rows = with_words(with_words(rows, "a", "wa"), "b", "wb").select("k", likeness(F.col("wa"), F.col("wb")).alias("near"), as_text(F.col("wa")).alias("text"), as_text(F.col("wb")).alias("other"))
    rows = rows.withColumn("read", likeness_of_text(F.col("text"), F.col("other"))).withColumn("back", as_text(words_of_text(F.col("text"))))
    for r in rows.collect():
        assert r.read == r.near
        assert r.back == r.text
        i, j = pairs[r.k]
        assert abs(r.near - exact_likeness(texts[i], texts[j])) < 1e-9, pairs[r.k]
        assert r.text == hexed(words(texts[i]))
