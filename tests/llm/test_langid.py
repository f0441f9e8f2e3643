"""Language identification: held-out accuracy, level structure and odd rows."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from strata.llm import langid
from strata.llm.queries import op1_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op1_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    hits = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert len(hits) > 200
    assert np.mean(hits) > 0.97
    for d in docs:
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        assert 0 <= got[d.doc_id].score <= 1


def test_odd_rows(spark, odd_docs, no_docs, documents):
    model = langid.fit(documents.select("doc_id", "text", "lang"), sample_per_language=50)
    rows = langid.identify(odd_docs, model).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters), texts[r.doc_id]
        assert r.lang_pred in {"und", *model.langs}
        assert r.score == 0 or letters
    assert langid.identify(no_docs, model).collect() == []
    nothing = langid.fit(no_docs.select("doc_id", "text", "lang"))
    assert {(r.lang_pred, r.score) for r in langid.identify(documents, nothing).collect()} == {("und", 0.0)}
    one = langid.fit(documents.select("doc_id", "text", F.lit("fi").alias("lang")))
    assert {r.lang_pred for r in langid.identify(documents, one).collect()} == {"fi"}


def test_family_decides_before_language():
    machines = {("germanic", "romance"): np.zeros(langid.SLOTS + 1), ("de", "en"): np.zeros(langid.SLOTS + 1), ("es", "fr"): np.zeros(langid.SLOTS + 1)}
    machines[("germanic", "romance")][-1] = -1.0
    machines[("de", "en")][-1] = 5.0
    machines[("es", "fr")][-1] = 0.5
    lang, score = langid.Model(["de", "en", "es", "fr"], machines).predict(np.array([1, 2, 3]))
    assert lang == "es"
    assert abs(score - 1 / (1 + np.exp(-1.5))) < 1e-12
    assert langid.family("xx") == "=xx"


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows, sign = [], []
    for i in range(200):
        s = 1 if i % 4 == 0 else -1
        slots = np.unique(rng.integers(0, 50, 10) + (0 if s > 0 else 40))
        rows.append((slots, np.full(len(slots), 1 / np.sqrt(len(slots)))))
        sign.append(s)
    w = langid.fit_svm(rows, np.array(sign, float))
    right = [np.sign(w[s] @ v + w[-1]) == y for (s, v), y in zip(rows, sign, strict=True)]
    assert np.mean(right) > 0.97


def test_trigrams_stay_inside_their_text():
    def grams(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        slots, at = langid.trigram_slots(raw, np.array([0, len(raw)]))
        return sorted(x for x in slots[at[0] : at[1]].tolist() if x >= 0)

    texts = ["ab cd", "", "É", "éa b", "A", "a 1 b"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    slots, at = langid.trigram_slots(raw, off)
    for t, s, e in zip(texts, at[:-1], at[1:], strict=True):
        assert sorted(x for x in slots[s:e].tolist() if x >= 0) == grams(t)
    assert grams("É") == grams("é")
    assert grams("ABC") == grams("abc")


def plain_features(text):
    """{slot: value} of a text: letter trigrams counted one by one."""
    codes, before = [], 0
    for b in text.encode():
        if 97 <= b <= 122 or 65 <= b <= 90:
            codes.append((b | 32) - 96)
        elif b >= 128:
            codes.append(b | 32 if before == 0xC3 and 0x80 <= b <= 0x9E else b)
        else:
            codes.append(0)
        before = b
    counts, codes = {}, [0, *codes, 0]
    for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
        if (x or y) and (y or z):
            slot = ((x << 16 | y << 8 | z) * 0x9E3779B1 % (1 << 32)) >> 18
            counts[slot] = counts.get(slot, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    return {s: math.sqrt(n) / norm for s, n in sorted(counts.items())}


def plain_machine(rows):
    """Weights {slot: w, None: bias} of (features, side) rows."""
    rows = sorted(rows, key=lambda r: (struct.pack(f"{len(r[0])}i", *r[0]), struct.pack(f"{len(r[0])}f", *r[0].values())))
    n_of = {s: sum(side == s for _, side in rows) for s in (1, -1)}
    upper = [langid.COST * len(rows) / (2 * max(n_of[side], 1)) for _, side in rows]
    alpha, w, rng = [0.0] * len(rows), {}, np.random.default_rng(7)
    for _ in range(langid.PASSES):
        for i in rng.permutation(len(rows)).tolist():
            x, side = {**rows[i][0], None: 1.0}, rows[i][1]
            grad = side * sum(w.get(s, 0.0) * v for s, v in x.items()) - 1
            new = min(max(alpha[i] - grad / sum(v * v for v in x.values()), 0.0), upper[i])
            for s, v in x.items():
                w[s] = w.get(s, 0.0) + (new - alpha[i]) * side * v
            alpha[i] = new
    return w


def plain_choice(names, margin):
    """Most wins, then largest sum of margins, then name; with the least margin of the winner."""
    ranked = []
    for a in names:
        own = [margin(a, b) for b in names if b != a]
        ranked.append((-sum(m > 0 for m in own), -sum(own), a, min(own, default=math.inf)))
    return min(ranked)[2:]


def test_equals_the_plain_version(spark):
    """Fit and prediction against loops over texts: two families of two and three languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null").select("doc_id", "text", "lang").orderBy("doc_id").limit(120).collect()
    docs = [(r.doc_id, r.text[:300], r.lang) for r in docs]
    docs += [(10_000 + k, t, x) for k, (t, x) in enumerate([("Ünïted ÉTAT àb", "fr"), ("ÀB éta c", "fr"), ("der die und", "de"), ("DAS ist es", "de")])]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table, langid.fit(table, sample_per_language=10_000)).collect()}

    x = {i: plain_features(t) for i, t, _ in docs}
    langs = sorted({lang for _, _, lang in docs})
    groups = {}
    for lang in langs:
        groups.setdefault(langid.family(lang), []).append(lang)
    assert len(groups) > 1
    assert max(len(g) for g in groups.values()) > 1

    def machines(names, label):
        return {(a, b): plain_machine([(x[i], 1 if label(lang) == a else -1) for i, _, lang in docs if label(lang) in (a, b)]) for a in names for b in names if a < b}

    both = [machines(sorted(groups), langid.family)] + [machines(own, lambda v: v) for own in groups.values()]
    weights = {pair: w for m in both for pair, w in m.items()}

    def margin(features, a, b):
        w = weights[min(a, b), max(a, b)]
        m = sum(w.get(s, 0.0) * v for s, v in features.items()) + w.get(None, 0.0)
        return m if a < b else -m

    for i, _, _ in docs:
        group, first = plain_choice(sorted(groups), lambda a, b, i=i: margin(x[i], a, b))
        lang, second = plain_choice(groups[group], lambda a, b, i=i: margin(x[i], a, b))
        assert got[i][0] == lang
        assert abs(got[i][1] - 1 / (1 + math.exp(-3 * min(max(min(first, second), -20), 20)))) < 1e-4
