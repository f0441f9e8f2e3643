"""Pfair mixing: brute-force schedule, the block bound, and the SQL form."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import pytest

from strata.llm.mixing import SQL, in_mix_order, mix_sources, schedule
from strata.llm.queries import op7_mix_sources


def edf(units):
    """{(source, k): slot} by earliest deadline first, ties by source order."""
    names, p = sorted(units), sum(units.values())
    done, out = dict.fromkeys(names, 0), {}
    for t in range(p):
        ready = [(-(-(done[s] + 1) * p // units[s]), s) for s in names if done[s] < units[s] and done[s] * p // units[s] <= t]
        s = min(ready)[1]
        out[(s, done[s])] = t
        done[s] += 1
    return out


@pytest.mark.parametrize("units", [{"a": 1}, {"a": 3, "b": 5, "c": 7}, {"a": 1, "b": 1, "c": 98}, {f"s{i}": i * i + 1 for i in range(9)}])
def test_schedule_is_edf_and_stays_within_one_block(spark, units):
    rows = schedule(spark.createDataFrame(list(units.items()), "source string, units int")).collect()
    assert {(r.source, r.k): r.slot_in_period for r in rows} == edf(units)
    p = sum(units.values())
    assert sorted(r.slot_in_period for r in rows) == list(range(p))
    for s, u in units.items():
        slots = sorted(r.slot_in_period for r in rows if r.source == s)
        for t in range(p + 1):
            assert abs(Fraction(u * t, p) - sum(x < t for x in slots)) < 1
        assert all(k * p // u <= x < -(-(k + 1) * p // u) for k, x in enumerate(slots))


def test_rows_follow_the_plan(documents):
    rows = mix_sources(documents, block_chars=500).collect()
    assert len(rows) == documents.count()
    assert all(r._release <= r._slot < r._due for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
        before = 0
        for r in own:
            assert (r._before, r._block) == (before, before // 500)
            before += len(r.text or "")


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "ab"[i % 2], 1) for i in range(400)], "doc_id long, text string, source string, _slot int".replace("_slot", "slot"))
    rows = mix_sources(docs, {"a": 3.0, "b": 1.0}, block_chars=100, period=4).orderBy("_slot").collect()
    first = [r.source for r in rows[:200]]
    for n in range(1, 200):
        assert abs(first[:n].count("a") - 0.75 * n) < 1
    assert len(rows) == 400
    assert [r.doc_id for r in in_mix_order(mix_sources(docs, {"a": 3.0, "b": 1.0}, block_chars=100, period=4)).collect()] == [r.doc_id for r in rows]


def test_odd_rows(odd_docs, no_docs):
    rows = mix_sources(odd_docs).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.batch) for r in rows))) == sorted(map(str, ((r.doc_id, r.text, r.batch) for r in odd_docs.collect())))
    assert mix_sources(no_docs).collect() == []
    assert in_mix_order(mix_sources(no_docs)).columns == no_docs.columns


def test_sql(spark, duck):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = op7_mix_sources(spark, sf).toPandas()
        want = duck(sf).execute(SQL).df()
        key = list(want.columns)
        assert sorted(got.columns) == sorted(key)
        assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_long_documents_stay_within_one_block_and_one_document(spark):
    rows = [(i, "x" * (1050 if i % 7 == 0 else 30), "ab"[i % 2]) for i in range(400)]
    mixed = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 2.0, "b": 1.0}, block_chars=100, period=3).collect()
    over = 0
    for s, u in (("a", 2), ("b", 1)):
        own = [(r._slot, len(r.text)) for r in mixed if r.source == s]
        for t in range(min(max(r._slot for r in mixed if r.source == x) for x in "ab") + 1):
            extra = sum(n for slot, n in own if slot < t) - Fraction(u * t, 3) * 100
            assert -100 < extra < 100 + 1050
            over = max(over, extra)
    assert over > 100  # one block alone is not a bound


def test_order_of_the_mix_with_clashing_columns(odd_docs):
    out = in_mix_order(mix_sources(odd_docs))
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
