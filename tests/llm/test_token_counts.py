"""Token counts against the tokenizers library over whole texts."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strata.llm.token_counts import build_table, frequent_table, probe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, **options):
    lib = Tokenizer.from_file(PATH)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts(docs, PATH, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_empty_table(no_docs):
    assert token_counts(no_docs, PATH).collect() == []


def test_table_probe_finds_what_was_stored():
    h = np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    n = (np.arange(5000) % 7 + 1).astype(np.uint16)
    keys, lens = build_table(h, n, bits=14)
    got = probe(np.concatenate([h, h + np.uint64(1)]), keys, lens, bits=14)
    assert (got[5000:] == 0).all()
    found = got[:5000] > 0
    assert found.mean() > 0.99
    assert (got[:5000][found] == n[found]).all()


def test_pretoken_of_more_tokens_than_the_table_holds(spark):
    import random

    rnd = random.Random(4)
    run = "".join(rnd.choice("zqxjkvwb") for _ in range(150_000))
    docs = spark.createDataFrame([(1, run), (2, "a few words " * 4), (3, run[:5000])], "doc_id long, text string")
    assert len(Tokenizer.from_file(PATH).encode(run, add_special_tokens=False).ids) > 1 << 16
    check(docs)


def test_table_is_learned_from_all_documents(spark):
    import itertools

    from strata.llm import vec

    words = ["".join(w) for w in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz")][:3000]
    rows = [(i, w) for i, w in enumerate(words)] * 2
    keys, lens = frequent_table(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    h = vec.pretokens(words, "byte_level")[0]
    assert len(h) == len(words)
    assert (probe(h, keys, lens) > 0).all()


def test_summaries_stay_bounded_and_merge_in_a_tree(spark, monkeypatch):
    """Common pre-tokens survive pruning in tasks and merges over many partitions; rare ones may go."""
    import random

    from pyspark.sql import functions as F

    from strata.llm import token_counts as tc, vec

    monkeypatch.setattr(tc, "_FAN", 3)
    rnd = random.Random(5)
    common = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join([*common, *(f"w{rnd.randrange(10**6)}" for _ in range(20))])) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    task_rows = tc.task_summaries(docs, PATH, 16).collect()
    assert len(task_rows) == 23 and all(len(r.h) <= 8 * 16 for r in task_rows)
    keys, lens = frequent_table(docs, PATH, entries=16)
    assert (lens > 0).sum() <= 16
    assert (probe(vec.pretokens([" " + w for w in common[1:]], "byte_level")[0], keys, lens) > 0).all()
    plan = token_counts(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    check(docs.where(F.col("doc_id") < 100))
