"""Line dedup against a plain version."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from strata.llm.line_dedup import line_chunks, line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def chunks(text):
    lines = (text or "").split("\n")
    h = [md5(x) for x in lines]
    roll = [md5((h[i - 1] if i else "") + h[i]) for i in range(len(lines))]
    long = [len(WORD.findall(x)) >= 50 for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        last = i == len(lines) - 1
        low = 0 < i < len(lines) - 1 and roll[i] < roll[i - 1] and roll[i] < roll[i + 1]
        if last or long[i] or long[i + 1] or low:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def spans(text):
    """(first, lines) of removable chunks and of the shortest runs of 50 words from and to a line."""
    lines = (text or "").split("\n")
    words = [len(WORD.findall(x)) for x in lines]
    out, at = set(), 0
    for c in chunks(text):
        n = sum(words[at : at + len(c)])
        if (len(c) >= 2 and n >= 10) or n >= 50:
            out.add((at, len(c)))
        at += len(c)
    for i in (i for i, n in enumerate(words) if n):
        out |= {(i, j - i) for j in range(i + 1, len(lines) + 1) if sum(words[i:j]) >= 50 > sum(words[i : j - 1])}
        out |= {(j, i + 1 - j) for j in range(i + 1) if sum(words[j : i + 1]) >= 50 > sum(words[j + 1 : i + 1]) and words[j]}
    return [(k, lines[k : k + n]) for k, n in sorted(out)]


def brute(rows):
    """{(doc_id, text): new text} of (doc_id, text) rows."""
    first, out = {}, {}
    listed = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    for doc_id, text in listed:
        for k, c in spans(text):
            first.setdefault("\n".join(c), (doc_id, k))
    for doc_id, text in rows:
        if doc_id is None or text is None:
            out[(doc_id, text)] = text
            continue
        gone = {k + j for k, c in spans(text) if first["\n".join(c)] != (doc_id, k) for j in range(len(c))}
        out[(doc_id, text)] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = line_dedup(docs.withColumn("was", F.col("text")))
    assert got.columns == [*docs.columns, "was", "_n_removed"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[(r.doc_id, r.was)], r.doc_id
        assert (r._n_removed > 0) or r.text == r.was
    return got


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r._n_removed for r in got) > 20


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert line_dedup(no_docs).collect() == []


def test_chunks_join_back_to_the_text(documents):
    rows = line_chunks(documents.select("doc_id", "text")).select("text", F.array_join(F.transform("chunks", lambda c: c["text"]), "\n").alias("joined"), "chunks").collect()
    assert all(r.text == r.joined for r in rows)
    assert all([c.text for c in r.chunks] == ["\n".join(c) for c in chunks(r.text)] for r in rows)


def test_passage_survives_shifts_and_keeps_its_first_copy(spark):
    passage = "\n".join(f"line {i} of a passage that is repeated in several documents word{i * 7919 % 101}" for i in range(30))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "own start one\n" + passage + "\nown end one"), (2, "a\nb\nc\nd\n" + passage + "\nz"), (3, "intro\n" + long + "\nrest of three"), (4, long), (5, "clean text\nof its own")]
    got = {r.doc_id: r for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1].text == rows[0][1]
    assert len(got[2].text) < 0.3 * len(rows[1][1])
    assert long in got[3].text
    assert got[4].text == ""
    assert got[5].text == rows[4][1]


def test_planted_passages_of_short_lines(spark):
    """Passages of 50 words and more over 2 to 10 lines, each in two unrelated documents."""
    import random

    rng = random.Random(5)

    def line(n):
        return " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))

    rows, planted = [], {}
    shapes = [(2, 30), (3, 20), (4, 15), (5, 12), (6, 49), (10, 49), (10, 5)]
    for k in range(20 * len(shapes)):
        n, words = shapes[k % len(shapes)]
        passage = [line(words if k % 2 else max(1, words + rng.randrange(-4, 8))) for _ in range(n)]
        if sum(len(x.split()) for x in passage) < 50:
            passage.append(line(50))
        for copy in (0, 1):
            own = [[line(rng.randrange(3, 40)) for _ in range(rng.randrange(0, 8))] for _ in (0, 1)]
            rows.append((2 * k + copy, "\n".join([*own[0], *passage, *own[1]])))
            planted[2 * k + copy] = (passage, "\n".join(own[0] + own[1]))
    rows += [(10_000 + k, "\n".join(line(rng.randrange(3, 40)) for _ in range(12))) for k in range(50)]
    got = {r.doc_id: r.text for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    for doc_id, text in rows:
        if doc_id % 2 and doc_id in planted:
            assert got[doc_id] == planted[doc_id][1]  # the second copy goes whole, its own lines stay
        else:
            assert got[doc_id] == text


def test_runs_with_blank_lines_ties_and_repeated_ids(spark):
    verse = "one two three four five six seven\n\n" * 9
    rows = [
        (1, verse + "end"), (2, "start\n\n" + verse.replace("\n\n", "\n")), (3, "other\n\n\n" + verse + "\n\nlast"),
        (4, "x\n" + " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(30))),
        (4, " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(30)) + "\ny"),
        (4, "short"), (5, None), (None, verse),
    ]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_equal_hash_is_not_enough(spark, monkeypatch):
    """With a hash that puts unlike chunks together, the byte comparison keeps them."""
    from strata.llm import line_dedup as m

    rows = [(i, f"first line of number {i} with some words\nsecond line of number {i} with some words") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = F.md5
    monkeypatch.setattr(m.F, "md5", lambda c: F.substring(real(c), 1, 0))
    assert {r.text for r in line_dedup(docs).collect()} == {t for _, t in rows}
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10))
    assert sorted(r.text for r in line_dedup(twice).collect()) == sorted([t for _, t in rows] + [""] * 6)
