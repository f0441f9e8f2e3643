"""The staged pipeline against the operators' plain versions, stage by stage and from end to end."""

from __future__ import annotations

import public_tokenizers
import zstandard

import corpus_pipeline
from strata.llm import tokens
from strata.llm.mixing import mix_sources
from strata.llm.quality import compression_verdict
from strata.sources.tables import in_stored_order, write_shared_table

from .test_line_dedup import brute as plain_dedup
from .test_ngram_join import brute as plain_join
from .test_quality import brute as plain_quality

SF = "/root/testdata/sf0.001"


def good(text):
    facts = plain_quality(text)
    body, pack = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    if facts[5]:
        return False
    chunks = [4096 / len(pack.compress(body[i : i + 4096])) for i in range(0, len(body) - 4095, 4096)] if len(body) > 4096 else [facts[7]]
    return compression_verdict(len(body), facts[7], min(chunks), max(chunks)) is None


def plain_run(rows):
    """{doc_id: text} that reach the encoder."""
    rows = [(i, t) for i, t in rows if good(t)]
    new = plain_dedup(rows)
    rows = [(i, new[(i, t)]) for i, t in rows if new[(i, t)] or not t]
    classes = {i: c for i, c, _ in plain_join(rows)}
    return {i: t for i, t in rows if classes[i] == i}


def test_run_equals_the_plain_version(spark, documents):
    want = plain_run([(r.doc_id, r.text) for r in documents.collect()])
    lib = tokens.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        ids = lib.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert 0 < len(got) < documents.count()


def test_stages_keep_the_columns(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join"
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns
        assert docs.dtypes == documents.dtypes
    assert docs.count() > 0


def test_empty_and_odd_inputs(spark, documents):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text " * 20, None, None, 1), (3, "x" * 9000, "en", None, None)]
    odd = spark.createDataFrame(rows, documents.schema)
    for docs in (documents.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_mixing_stage_orders_the_documents(spark, documents):
    from strata.llm.mixing import mix_sources

    want = [r.doc_id for r in mix_sources(documents).orderBy("_slot", "_before").collect()]
    assert [r.doc_id for r in corpus_pipeline.mixing_stage(spark, documents, SF).collect()] == want


def _in_files(spark, docs):
    """As the pipeline passes a stage's result on."""
    return write_shared_table(docs, "test-stage")


def test_the_mix_orders_the_encoded_stream(spark, documents):
    """Each document starts where those before it in the mix end; another mix gives another stream."""
    docs = documents.where("doc_id % 3 = 0")
    mixed = mix_sources(docs).orderBy("_slot", "_before").select("doc_id").collect()
    got = {r.doc_id: r for r in corpus_pipeline.encoding_stage(spark, _in_files(spark, corpus_pipeline.mixing_stage(spark, docs, SF)), SF).collect()}
    assert len(got) == len(mixed) > 50
    at = 0
    for r in mixed:
        assert got[r.doc_id].start == at
        at += got[r.doc_id].n_tokens
    plain = corpus_pipeline.encoding_stage(spark, _in_files(spark, docs.orderBy("doc_id")), SF).collect()
    assert {r.doc_id: r.start for r in plain} != {i: r.start for i, r in got.items()}
    assert {r.doc_id: bytes(r.ids) for r in plain} == {i: bytes(r.ids) for i, r in got.items()}


def test_stored_order_of_odd_rows(spark):
    """Repeated rows and null ids keep a place each, also of rows that come from no file."""
    rows = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (2, None)], "doc_id long, text string").repartition(3)
    got = in_stored_order(rows).collect()
    assert len({r._place for r in got}) == 4
    out = corpus_pipeline.encoding_stage(spark, rows, SF).orderBy("start", "n_tokens").collect()
    ends = [0]
    for r in out:
        assert r.start == ends[-1]
        ends.append(r.start + r.n_tokens)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 1), (False, 2), (True, 0)]
