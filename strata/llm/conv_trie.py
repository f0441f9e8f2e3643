"""Trie of conversation prefixes by van Emde Boas recursion over turn rows.

A conversation is a sequence of turn digests, one row per turn. Every prefix of d turns is a node,
named by the smallest conversation that starts with it and by its depth d.

* Cut and name: the sequences are cut at half of the largest depth; the prefixes at the cut are
  named by (name at the cut above, hash of the turns between the cuts), a grouped minimum. The
  upper trie and all lower forests are cut again at their own half, all of one size in one job, so
  there are as many rounds as the largest depth has binary digits, and the rounds together group
  each turn once.
* Graft: from the smallest forests up, the total of each lower forest is added to every node of
  the upper trie on the way to its cut.

Nothing gathers a conversation, a prefix's members or a node's children into one row: sequences
stay rows, hashes of turn runs are sums over rows, and the digest of the members that end at a node
is streamed over packed runs of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.prefix import ordered_rank
from strata.sources.tables import write_shared_table

#: Rebuilding: conversations share the first turns of the first one of their hundred; at most five.
GROUP, HEADS = 100, 6
_TURNS_PER_BUCKET = 1 << 16
_IDS_PER_RUN = 256


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, p, digest, chars): the turns of each conversation in the order of ``turn`` (null
    first, then by digest); p counts from 1. Null role and text are empty; rows without a
    conversation id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    bucket = F.coalesce(F.floor(F.col("turn") / _TURNS_PER_BUCKET), F.lit(-(1 << 62)))
    ranked = ordered_rank(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], bucket, "p")
    return ranked.select("conv", F.col("p").cast("long").alias("p"), "digest", "chars")


def head_size(conv: Column) -> Column:
    """Turns that a rebuilt conversation takes over: crc32 of its decimal id modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations of ``turn_rows``: (conv, pos, digest, chars) and (conv, n_turns), the
    latter also for conversations left without a turn.

    Conversation c starts with the first h turns of conversation c - c % 100 (all if it has fewer,
    none if there is no such conversation), h = ``head_size``; its own turns after its first h follow."""
    own = write_shared_table(turns.withColumn("h", head_size(F.col("conv"))), "trie-turns")
    donors = own.where((F.col("conv") % GROUP == 0) & (F.col("p") < HEADS)).groupBy(F.col("conv").alias("donor")).agg(
        F.sort_array(F.collect_list(F.struct("p", "digest", "chars"))).alias("head")
    )
    convs = own.groupBy("conv", "h").agg(F.max("p").alias("n_own")).withColumn("donor", F.col("conv") - F.col("conv") % GROUP)
    convs = convs.join(donors, "donor", "left").select(
        "conv", "n_own", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<p:bigint,digest:string,chars:bigint>>")), F.lit(1), F.col("h").cast("int")).alias("head")
    )
    convs = write_shared_table(convs.withColumn("n_head", F.size("head").cast("long")), "trie-conversations")
    heads = convs.select("conv", F.inline("head")).select("conv", F.col("p").alias("pos"), "digest", "chars")
    tails = own.where("p > h").join(convs.select("conv", "n_head"), "conv").select(
        "conv", (F.col("p") - F.col("h") + F.col("n_head")).alias("pos"), "digest", "chars"
    )
    sizes = convs.select("conv", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return heads.unionByName(tails), sizes


def _name_round(rows: DataFrame, above: DataFrame | None, root: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Names at all depths that are odd multiples of 2**k: (conv, depth, name) of every member and
    (conv, depth, parent, n_convs, chars) of every node (``parent`` is the name at the cut above).
    ``above`` holds the names at the even multiples."""
    block = F.shiftright(F.col("pos") - 1, k)
    runs = (
        rows.where(block % 2 == 0).groupBy("conv", block.alias("block"))
        .agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n"), F.max(F.struct("pos", "chars"))["chars"].alias("chars"))
        .where(F.col("n") == 1 << k)
        .select("conv", (F.col("block") * (1 << k)).alias("start"), ((F.col("block") + 1) * (1 << k)).alias("depth"), "a", "b", "chars")
    )
    first = runs.where("start = 0").withColumn("cut", F.lit(root).cast("long"))
    if above is not None:
        later = above.select("conv", F.col("depth").alias("start"), F.col("name").alias("cut"))
        first = first.unionByName(runs.where("start > 0").join(later, ["conv", "start"]))
    key = ["cut", "depth", "a", "b"]
    runs = write_shared_table(first.select("conv", "chars", *key), f"trie-runs-{k}")
    named = runs.groupBy(*key).agg(F.min("conv").alias("name"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    named = write_shared_table(named, f"trie-named-{k}")  # a plain shuffle on either side: a hot prefix can be split
    members = write_shared_table(runs.drop("chars").join(named.select(*key, "name"), key).select("conv", "depth", "name"), f"trie-members-{k}")
    return members, named.select(F.col("name").alias("conv"), "depth", F.col("cut").alias("parent"), "n_convs", "chars")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): digest of the ascending ids ``member`` of each (conv, depth),
    joined by commas. Ids are packed into runs of 256 neighbours in parallel; the runs of one node
    are then streamed through one hash, however many there are."""
    run = F.floor(F.col("member") / _IDS_PER_RUN)
    packed = ends.groupBy("conv", "depth", run.alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids")
    )
    dealt = packed.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "run").select("conv", "depth", "ids")
    schema = "conv long, depth long, ends_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for c, d, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (c, d) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (c, d), hashlib.sha256(ids.encode())
            yield _digest_batch(done)
        if node is not None:
            yield _digest_batch([(*node, state.hexdigest())])

    return dealt.mapInArrow(digest, schema)


def _digest_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    c, d, s = ([r[i] for r in rows] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], names=["conv", "depth", "ends_sha256"])


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes of the trie of the sequences ``turns`` (conv, pos from 1 without gaps, digest, chars);
    ``sizes`` (conv, n_turns) names every conversation, also those without turns.

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its
    subtree, (n_convs - 1) times the characters of each node's last turn) and ends_sha256. Two
    sequences share a node if the 128-bit hashes of their turns' digests agree. No conversation: no node."""
    zero = F.lit(0).cast("long")
    least = sizes.agg(F.min("conv").alias("root"), F.count("*").alias("n"), F.max("n_turns").alias("longest")).first()
    hashed = turns.select("conv", "pos", "chars", F.xxhash64(F.lit(1), "digest", "pos").alias("a"), F.xxhash64(F.lit(2), "digest", "pos").alias("b"))
    rows = write_shared_table(hashed, "trie-rows")
    root = least["root"] if least["n"] else 0
    levels = (least["longest"] or 0).bit_length()

    # downwards: the cut in the middle of the whole first, single turns last
    paths, nodes, known = [], [], None
    for k in reversed(range(levels)):
        member, node = _name_round(rows, known, root, k)
        paths.append(member)
        nodes.append(node if k == 0 else node.drop("parent"))
        known = _union(paths)

    columns = "conv long, depth long, parent long, n_convs long, n_children long, leaves long, saved long"
    spark = turns.sparkSession
    if not levels:
        tree, grafts = spark.createDataFrame([], columns), []
    else:
        # an odd depth's cut above is its parent; an even one's parent has been named by the last round
        even = nodes[:-1]
        below = paths[-1].select(F.col("conv"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
        every = nodes[-1].select("conv", "depth", "parent", "n_convs", "chars")
        if even:
            every = every.unionByName(_union(even).join(below, ["conv", "depth"]).select(*every.columns))
        every = write_shared_table(every, "trie-nodes")
        children = every.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        tree = every.join(children, ["conv", "depth"], "left").select(
            "conv", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        )
        tree = write_shared_table(tree, "trie-tree")
        grafts = _graft(tree, known, levels)

    amounts = ["conv", "depth", "parent", "n_convs", "n_children", "leaves", "saved"]
    none = [F.lit(None).cast("long").alias(c) for c in ("parent", "n_convs", "n_children")]
    parts = [tree.select(*amounts)] + [g.select("conv", "depth", *none, "leaves", "saved") for g in grafts]
    total = _union(parts).groupBy("conv", "depth").agg(
        *(F.max(c).alias(c) for c in ("parent", "n_convs", "n_children")), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    total = write_shared_table(total, "trie-totals")
    top = total.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(
        F.lit(root).cast("long").alias("conv"), zero.alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.lit(least["n"]).cast("long").alias("n_convs"), "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), F.coalesce("saved", zero).alias("saved"),
    ).where("n_convs > 0")

    last = sizes.select("conv", F.col("n_turns").alias("depth"))
    ends = last.where("depth = 0").select(F.lit(root).cast("long").alias("conv"), "depth", F.col("conv").alias("member"))
    if levels:
        ends = ends.unionByName(last.join(known, ["conv", "depth"]).select(F.col("name").alias("conv"), "depth", F.col("conv").alias("member")))
    return total.unionByName(top).join(end_digests(ends), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _graft(tree: DataFrame, paths: DataFrame, levels: int) -> list[DataFrame]:
    """Amounts (conv, depth, leaves, saved) to add to the nodes of ``tree``: round k adds the totals
    of all forests of height 2**k to the nodes of the upper tries of the same height above them."""
    grafts: list[DataFrame] = []
    for k in range(levels):
        first = F.pmod(F.col("depth") - 1, F.lit(2 << k)) == 1 << k  # the uppermost nodes of the lower forests
        tops = tree.where(first).select("conv", "depth", "parent", "leaves", "saved")
        for g in grafts:
            tops = tops.unionByName(g.where(first).select("conv", "depth", F.lit(None).cast("long").alias("parent"), "leaves", "saved"))
        tops = tops.groupBy("conv", "depth").agg(F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        forests = tops.groupBy(F.col("parent").alias("conv"), F.shiftright(F.col("depth") - 2, k).alias("block")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        way = paths.select("conv", "depth", "name", F.shiftright(F.col("depth") - 1, k).alias("block")).where("block % 2 = 0")
        added = forests.join(way, ["conv", "block"]).groupBy(F.col("name").alias("conv"), "depth").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        grafts.append(write_shared_table(added, f"trie-graft-{k}"))
    return grafts


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations of (conv_id, turn, role, text) rows; other columns are not read.
    Repeated rows are turns of their own, ties in ``turn`` stand in the order of their digests."""
    return prefix_trie(*rebuild(turn_rows(conversations)))


#: The same rows in SQL; crc32 is taken over the decimal digits with its usual table.
SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))
), turns AS (
  SELECT conv_id AS c, length(coalesce("text", '')) AS chars, sha256(length(coalesce("role", '')) || ':' || coalesce("role", '') || coalesce("text", '')) AS t, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(struct_pack(t := t, chars := chars) ORDER BY turn NULLS FIRST, t) AS s FROM turns GROUP BY c
), heads AS (
  SELECT c, s, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: xor(a >> 8, crc_table.t[(xor(a, x) & 255) + 1])), 4294967295) % {HEADS} AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT x.c, list_concat(coalesce(d.s[1:x.h], []), x.s[x.h + 1:]) AS s FROM heads x LEFT JOIN own d ON d.c = x.c - x.c % {GROUP}
), prefixes AS (
  SELECT c, d, list_transform(s[1:d], lambda x: x.t) AS key, CASE WHEN d > 0 THEN s[d].chars ELSE 0 END AS chars, len(s) = d AS ends
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, key, min(c) AS c, count(*) AS n, max(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends
  FROM prefixes GROUP BY d, key
), children AS (
  SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT x.*, coalesce(y.n, 0) AS children FROM nodes x LEFT JOIN children y ON x.d = y.d AND x.key = y.key
), totals AS (
  SELECT a AS d, key[1:a] AS key, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1, 2
)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n AS n_convs, x.children AS n_children,
  t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN totals t ON x.d = t.d AND x.key = t.key LEFT JOIN nodes p ON p.d = x.d - 1 AND p.key = x.key[1:x.d - 1]
"""
