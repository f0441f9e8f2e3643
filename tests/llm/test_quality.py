"""Quality rules against a plain per-text version."""

from __future__ import annotations

import re

import zstandard

from strata.llm.quality import BANDS, compression_verdict, keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated.update(j for i in at for j in range(i, i + 8))
    lines, dup, old = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in old
            old.add(line)
    n_words = len(words)
    failed = n_words < 20 or 100 * len(repeated) > 30 * n_words
    body = text.encode()
    pack = zstandard.ZstdCompressor(level=3)
    ratio = len(body) / len(pack.compress(body)) if body else 0.0
    return n_words, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed, len(body), ratio


def check(rows, texts):
    for r in rows:
        n_words, chars, symbols, dup, repeat, failed, n_bytes, ratio = brute(texts[r.doc_id])
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_bytes)
        assert got == (n_words, chars, symbols, dup, repeat, failed, n_bytes), r.doc_id
        assert abs(r.ratio - ratio) < 1e-9
        verdict = compression_verdict(r.n_bytes, r.ratio, r.chunk_min, r.chunk_max)
        assert r.kept == (not failed and verdict is None)
        assert (r.reason is None) == r.kept


def test_documents_match_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = quality_rules(documents).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows(odd_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, texts)


def test_empty_table(no_docs):
    assert quality_rules(no_docs).collect() == []
    assert keep_good(no_docs).collect() == []


def test_keep_good_agrees_and_keeps_columns(documents, odd_docs):
    for docs in (documents, odd_docs):
        kept = {(r.doc_id) for r in quality_rules(docs).where("kept").collect()}
        out = keep_good(docs)
        assert out.schema.names == docs.schema.names
        rows = out.collect()
        assert {r.doc_id for r in rows} == kept
        assert {r.text for r in rows} <= {r.text for r in docs.collect()}


def test_bands_reject_repetition_and_noise(spark):
    import random

    rnd = random.Random(5)
    prose = " ".join("".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(30000))
    noise = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) + (" " if rnd.random() < 0.2 else "") for _ in range(3000))
    near = "".join(f"item {i % 7} of the list sells at {i} today and more is here now for you and all of us {i % 3}\n" for i in range(2000))
    rows = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(1, prose[:60000]), (2, near), (3, noise)], "doc_id long, text string")).collect()}
    assert rows[1].kept
    assert not rows[2].kept
    assert rows[3].ratio < 1.5
    assert compression_verdict(100, 0.5, 0.5, 0.5) is None
    assert compression_verdict(5000, 1.2, 1.2, 1.2) == "incompressible"
    assert [b[0] for b in BANDS] == sorted(b[0] for b in BANDS)


def test_the_end_of_a_text_is_in_a_chunk(spark):
    """A repetitive end shorter than a chunk counts, as it does when one more byte makes it a full chunk."""
    import random

    rnd = random.Random(9)
    prose = " ".join("".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(3000))
    texts = {1: prose[:4096] + "ab" * 2047 + "a", 2: prose[:4096] + "ab" * 2048, 3: prose[:8191], 4: prose[:4096], 5: prose[:4097]}
    rows = {r.doc_id: r for r in quality_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    pack = zstandard.ZstdCompressor(level=3)
    for i, text in texts.items():
        body = text.encode()
        starts = {*range(0, len(body) - 4095, 4096), len(body) - 4096}
        ratios = [4096 / len(pack.compress(body[s : s + 4096])) for s in starts]
        assert (rows[i].chunk_min, rows[i].chunk_max) == (min(ratios), max(ratios)), i
    assert not rows[1].base_failed
    assert rows[1].reason == rows[2].reason == "repetitive chunk"
    assert rows[3].kept and rows[4].kept and rows[5].kept
    assert [r.doc_id for r in keep_good(spark.createDataFrame([(1, texts[1]), (3, texts[3])], "doc_id long, text string")).collect()] == [3]
