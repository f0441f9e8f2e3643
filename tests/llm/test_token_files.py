"""Token files against the tokenizers library, read back from disk."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strata.llm import token_files, tokens, vec
from strata.llm.token_files import read_document, read_token_files, train_dictionary, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def write(docs, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_token_files(docs, folder, PATH, end_id=2)
    return folder


def expected(docs):
    lib = Tokenizer.from_file(PATH)
    return [(r.doc_id, [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]


def test_documents(spark, documents, tmp_path):
    folder = write(documents, tmp_path)
    want, start = sorted(expected(documents)), 0
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(want)
    for r, (doc_id, ids) in zip(got, want, strict=True):
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (doc_id, start, len(ids), zlib.crc32(raw))
        start += len(ids)
    for doc_id, ids in want[:5]:
        assert read_document(spark, folder, doc_id) == ids
    assert read_document(spark, folder, 10**12) is None


def test_odd_rows(spark, odd_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 3)
    got = read_token_files(spark, write(odd_docs, tmp_path)).orderBy("start").collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=key) == sorted(expected(odd_docs), key=key)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_empty_table(spark, no_docs, tmp_path):
    folder = write(no_docs, tmp_path)
    assert read_token_files(spark, folder).collect() == []
    assert read_document(spark, folder, 1) is None


def test_other_dictionary_is_refused(spark, documents, tmp_path):
    folder = write(documents, tmp_path)
    row = (("0" * 64, bytearray(train_dictionary([b"x" * 100]))),)
    spark.createDataFrame(row, "hash string, bytes binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        read_token_files(spark, folder).collect()


class Counting:
    """The library's tokenizer, with the number of texts that it gets."""

    def __init__(self):
        self.lib, self.texts = Tokenizer.from_file(PATH), 0

    def encode(self, text, **options):
        self.texts += 1
        return self.lib.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.lib.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_in_runs(monkeypatch):
    counting, lib = Counting(), Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokens, "load_tokenizer", lambda path: counting)
    monkeypatch.setattr(token_files, "_WORKER", {})
    letters = "abcdefghijklmnopqrstuvwxyzéßñ"
    texts = ["", " ".join(x + y + x for x in letters for y in letters), "don't 12 ½x", " ".join(x + x + y for x in letters for y in letters)]
    flat, counts = token_files.word_encoder(PATH, 2)(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert counting.texts < len(letters) ** 2 / 50


def test_joined_pretokens_keep_their_ids():
    lib = Tokenizer.from_file(PATH)
    known = np.isin(vec._classes()[:0xE0200], [vec._L, vec._N, vec._O])
    chars = [chr(i) for i in np.flatnonzero(known).tolist() if not 0xD800 <= i < 0xF900]  # no surrogates, no private use
    words = [*chars, "'s", "'", "".join(["x"] * 3000), "</w>", "<|", "|>"]
    flat, counts = tokens.encode_words(PATH, words)
    want = [e.ids for e in lib.encode_batch_fast(words, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]
    assert counts.min() > 0  # so a run never lacks one pre-token where it has another too many


@pytest.mark.parametrize("words", [[], ["one", "two words", "three"], ["one", " ", "three"], ["", "x"], ["<|endoftext|>", "don't", "x"]])
def test_pretokens_that_the_library_sees_otherwise(words):
    lib = Tokenizer.from_file(PATH)
    flat, counts = tokens.encode_words(PATH, words)
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert (counts.tolist(), flat.tolist()) == ([len(x) for x in want], [i for x in want for i in x])


def test_common_words_stay_in_a_full_cache():
    asked = []

    def encode(words):
        asked.extend(words)
        return tokens.id_arrays([[len(w)] * (len(w) % 3) + [ord(w[0])] for w in words])

    cache = tokens.PretokenCache(encode, limit=100)
    common = [f"c{i}" for i in range(20)]
    for step in range(50):
        words = common + [f"{'rare' * (i % 4)}r{step}-{i}" for i in range(30)]
        entry = cache.entries(words)
        got = np.split(cache.table.take(entry), np.cumsum(cache.table.count[entry])[:-1])
        assert [x.tolist() for x in got] == [[len(w)] * (len(w) % 3) + [ord(w[0])] for w in words]
        assert cache.table.n <= 100 and len(cache.entry) <= 100
    assert len(asked) == 20 + 50 * 30
    many = [f"m{i}" for i in range(500)]  # more at once than the limit
    assert cache.table.take(cache.entries(many)).tolist() == encode(many)[0].tolist()
    assert cache.table.take(cache.entries(many[:3])).tolist() == encode(many[:3])[0].tolist()
