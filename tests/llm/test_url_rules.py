"""URL rules against a plain version with exhaustive itemset counting."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from strata.llm.url_rules import DOMAIN_RULES, judge_urls, url_tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def given(host, path):
    best = None
    for rule, verdict in DOMAIN_RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


def brute(pages, labels, tokens, support, confidence, least):
    """[(page_id, host, path, rule, verdict)]"""
    block = {}
    for i, quality, toxic in labels:
        block[i] = block.get(i, False) or quality == 0 or toxic == 1
    known = [(frozenset(tokens[u]), block[i]) for i, u in pages if i in block]
    bad = [t for t, b in known if b and t]
    counts = {}
    for t in bad:
        for n in range(1, 5):
            for c in itertools.combinations(sorted(t), n):
                counts[c] = counts.get(c, 0) + 1
    rules = [set(c) for c, n in counts.items() if n >= support * len(bad) and n >= least and n / sum(set(c) <= t for t, _ in known) >= confidence]
    out = []
    for i, u in pages:
        host, path = split(u)
        rule, verdict = given(host, path)
        out.append((i, host, path, rule, verdict or ("block" if any(r <= set(tokens[u]) for r in rules) else "allow")))
    return out, rules


def run(pages, labels, **options):
    return [tuple(r)[:5] for r in judge_urls(pages, labels, **options).collect()]


def compare(pages, labels, **options):
    rows = [(r.page_id, r.url) for r in pages.collect()]
    tokens = {r.url: r.t for r in pages.select("url", url_tokens(F.col("url")).alias("t")).collect()}
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    o = {"min_support": 0.005, "min_confidence": 0.8, "min_pages": 5} | options
    want, rules = brute(rows, marks, tokens, o["min_support"], o["min_confidence"], o["min_pages"])
    assert sorted(map(str, run(pages, labels, **options))) == sorted(map(str, want))
    return rules


def test_pages(spark):
    for sf in ("sf0.001", "sf0.01"):
        read = lambda t, sf=sf: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
        compare(read("pages"), read("labels"))
        compare(read("pages"), read("labels"), min_support=0.02, min_confidence=0.4, min_pages=2)


def test_mined_combination_blocks(spark):
    rows = [(i, f"https://{'bad' if i % 2 else 'good'}.example.net/{'ads' if i % 3 == 0 else 'news'}/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if (i % 2 and i % 3 == 0) else 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    rules = compare(pages, labels)
    assert {"h:bad", "p:ads"} in rules
    got = {r[0]: r[4] for r in run(pages, labels)}
    assert got[111] == "block"  # not labelled
    assert got[110] == got[113] == "allow"


ODD = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://Example.ORG/es/x", "ftp://a.b://c/d", "http://x.com/de/1?q=http://y.org/", "http://x.com/fr/?a", "http://aorg/x",
       "http://org/", "http://example.org/en/12#f", "http://example.org?x/en/1", "http://ÄB.example.org/é", "://org/x", "http://a.com/de", "x\nhttp://a.org/b\nc"]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)] + [(4, ODD[4]), (None, "http://org/z")], "page_id long, url string")
    labels = spark.createDataFrame([(0, 0, 1), (4, 0, None), (4, None, 0), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    compare(pages, labels, min_pages=1)
    compare(pages, labels.limit(0))
    assert run(pages.limit(0), labels) == []


def test_rules_of_any_length(spark):
    """All five segments together are block-specific; every smaller combination also fits allowed pages."""
    parts = ["ads", "buy", "cash", "deal", "extra"]
    urls = ["http://x.net/" + "/".join(parts)] * 20 + ["http://x.net/" + "/".join(p for p in parts if p != out) for out in parts for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 20 else 1, 0) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    tokens = [frozenset(r.t) for r in pages.select(url_tokens(F.col("url")).alias("t")).collect()]
    sets = [frozenset(c) for n in range(1, len(tokens[0]) + 1) for c in itertools.combinations(sorted(tokens[0]), n)]
    rules = [c for c in sets if 20 / sum(c <= t for t in tokens) >= 0.8]  # only block pages hold all of tokens[0]; each set occurs in all 20
    assert min(map(len, rules)) == 5
    got = {r.page_id: r for r in judge_urls(pages, labels).collect()}
    for i, t in enumerate(tokens):
        n = sum(c <= t for c in rules)
        assert (got[i].verdict, got[i].n_rules) == ("block" if n else "allow", n)
    assert [got[i].verdict for i in (0, 20)] == ["block", "allow"]


def test_long_urls(spark):
    """A trap of 40 segments on many block pages: its tokens are one class. A page with any one of them is blocked,
    as each token is a rule by itself; tokens that allowed pages share are not."""
    deep = "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    urls = [f"http://x.net/{deep}"] * 60 + [f"http://x.net/{w}" for w in ("news", "shop", "help") for _ in range(40)] + ["http://x.net/sbn/more", "http://x.net/other"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 60 else 1, 0) for i in range(180)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in judge_urls(pages, labels).collect()}
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[i].verdict for i in range(60, 180)} == {"allow"}
    assert (got[180].verdict, got[180].n_rules, got[181].verdict, got[181].n_rules) == ("block", 1, "allow", 0)


def test_classes_keep_verdicts(spark):
    """Tokens that travel together on some pages and apart on others, against exhaustive counting."""
    import random

    rng = random.Random(5)
    urls = []
    for _ in range(300):
        words = [w for group in (("aa", "ab"), ("ba", "bb", "bc"), ("ca",), ("da", "db")) if rng.random() < 0.5 for w in group]
        urls.append("http://y.net/" + "/".join(words if rng.random() < 0.8 else words[:-1]))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("ba" not in u or rng.random() < 0.4), 0) for i, u in enumerate(urls) if i % 3], "doc_id long, quality int, toxic int")
    for confidence in (0.5, 0.65, 0.8):
        assert compare(pages, labels, min_support=0.02, min_confidence=confidence, min_pages=2) or confidence > 0.5
