"""Byte-level BPE against tiktoken, and the exact round trip."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from strata.llm import bpe, tokens, vec
from strata.llm.queries import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(docs):
    lib = tokens.load_encoding(PATH, public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = byte_bpe(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_empty_table(no_docs):
    assert byte_bpe(no_docs).collect() == []


def test_many_small_batches(documents, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 20_000)
    check(documents.repartition(3))


def test_only_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "_ROWS_OUT_BYTES", 0)
    check(spark.createDataFrame([(1, None), (2, ""), (3, "")], "doc_id long, text string"))


def test_decode_gives_the_text_back(odd_docs):
    enc = bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), bytes(r.data).decode()) for r in bpe.decode(enc, PATH).collect())
    assert got == sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())


def test_unknown_id_raises():
    with pytest.raises(ValueError):
        bpe.ByteTable({0: b"a", 1: b"b"}).join(np.array([5]))


def test_number_and_list_packing():
    pack, unpack = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    for x in ([], [0], [255, 256], [1 << 20, 3], [1 << 30]):
        a = np.array(x, np.int64)
        assert bpe.unpack_numbers(bpe.pack_numbers(a, pack), unpack).tolist() == x
        counts, body = bpe.unpack_lists(bpe.pack_lists(a, b"xyz", pack), unpack)
        assert counts.tolist() == x
        assert body == b"xyz"


def test_split_equals_pattern_on_random_strings():
    import random

    import regex

    rnd = random.Random(11)
    pattern = regex.compile(public_tokenizers.PATTERN)
    alphabet = list("ab sS'tTrevlmd  \n\t\r\x85\xa0 　 019²½٣ßéÉéͅ漢字🙂#$_-—​'''")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    _, counts, strings = vec.pretokens(texts, "byte_level")
    words = iter(strings(np.arange(int(counts.sum()))))
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert [next(words) for _ in range(n)] == pattern.findall(text)
