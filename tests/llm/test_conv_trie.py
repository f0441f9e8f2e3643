"""Conversation trie against a plain dictionary trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from strata.llm.conv_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[-1] for x in sorted(s)] for c, s in own.items()}
    members, rebuilt = {}, {}
    for c, s in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(donor, [])[:h] + s[h:])
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    out = {}
    for key, who in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key]
        below = [k for k in members if k[: len(key)] == key]
        inner = {k[:d] for k in members for d in range(len(k))}
        ends = sorted(c for c in who if len(rebuilt[c]) == len(key))
        out[(min(who), len(key))] = (
            min(members[key[:-1]]) if key else None, len(who), len(kids), sum(k not in inner for k in below),
            sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def check(spark, rows, schema=SCHEMA):
    got = conversation_trie(spark.createDataFrame(rows, schema)).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got)
    assert found == brute([r[:4] for r in rows])


def test_random_conversations(spark):
    rnd = random.Random(3)
    rows = []
    for c in rnd.sample(range(-120, 420), 70):
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t % 3 else "user", rnd.choice(["", "a", "bb", "🙂é", "long text " * 3])))
    check(spark, rows)


def test_odd_rows_ties_repeats_and_extra_columns(spark):
    rows = [
        (0, None, None, None, 1, "x"), (0, 1, "user", "a", 2, None), (0, 1, "user", "b", 3, None), (0, 1, "user", "b", 4, None),
        (1, 0, "user", "", 5, "y"), (1, 0, "use", "r", 6, "y"), (1, None, "user", "", 7, "y"), (2, 5, None, "x" * 5000, 8, "z"),
        (None, 1, "user", "nobody's", 9, "z"), (3, 1, "user", "b", 1, ""), (3, 1, "user", "b", 1, ""), (-205, 2, "a", "b", 0, None),
    ]
    check(spark, rows, SCHEMA + ", conv long, name string")


def test_copies_and_one_long_conversation(spark):
    """Thousands of conversations that end at one node, and one much deeper than the others."""
    base = [(0, "user", "hello"), (1, "assistant", "hi"), (2, "user", "how much"), (3, "assistant", "much"), (4, "user", "so"), (5, "user", "then")]
    rows = [(100 * c, *t) for c in range(700) for t in base]
    rows += [(77, k, "user", f"turn {k % 3}") for k in range(130)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")]])
def test_no_conversation(spark, rows):
    assert conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_turnless_conversations_leave_the_root(spark):
    """Conversations without a donor whose own turns are all cut off: the root alone, itself a leaf."""
    bare = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    check(spark, [(c, 0, "user", "only") for c in bare])
